"""What the corpus operators share: tables, scratch space on shared storage, text helpers."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the text contracts.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and the master is local, as in tests, a temporary folder takes its place: on a cluster each machine
    would write to a folder of its own.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet on shared storage and read it back.

    Later readers start from the files, so a lost executor costs a reread
    and never a recomputation with other row ids.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 16 << 20) -> None:
    """Hand texts to Python workers in batches of at most ``rows`` and some ``size`` bytes: they bound a worker's memory.

    Plans run after this call returns, so the session keeps the limits; lower ones of its own stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int(spark.conf.get(key).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Hand memory that this process has freed back to the machine: an idle Python worker keeps it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = scratch_dir(spark)
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if "/foliant/" in folder and root.split(":")[-1].lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def hex_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fresh_names(taken: list[str], *stems: str) -> list[str]:
    """A name for each stem that no column of ``taken`` has, whatever its case."""
    used, out = {name.lower() for name in taken}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most; its rows must be of bounded size."""
    return F.broadcast(df) if df.count() <= rows else df
