"""Line deduplication over levelled sorted runs of line hashes.

The store holds runs, tables bucketed and sorted by line hash; an entry is (hash, documents holding the line, largest document
id). Batches come in descending id ranges. A batch is counted, merge-anti-joined with the entries that are settled already, and what
is left is written as a new run of level 0: a key that one run holds with ``min_docs`` documents can neither gain a higher id nor
change its verdict. When a level has two runs they are merged into one run of the next level. The lines to drop are the entries
with ``min_docs`` documents, merged from all runs, and each document loses those whose keeper it isn't.

All runs have the same buckets, one sorted file each, so the anti-join and the merge read two sorted files side by side: neither
shuffles or sorts a run again. Only a batch's own counts are shuffled, into those buckets, after being combined in each task; a
line held by a third of all documents is a row a task there. Texts are read once for their hashes and once for the answer.

Hashes are 128 bits long. In the final joins a frequent line's rows, or those of a repeated id, are split at run time.

Cases: a null or empty text is one empty line. Rows that share an id are one document: a line in two of them counts once, and each
row keeps or loses lines by the same rule. Rows without id are together one document that ranks below all others; like all rows they
are joined by id and text, so they aren't gathered anywhere. A line that occurs twice in its keeper stays twice there. A document
that loses every line keeps the empty text. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, bounded, discard, hex_sha256, materialise, new_path, strip_blanks

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4

#: Drop lists up to this many entries (some 50 bytes each) are broadcast; longer ones are shuffled.
BROADCAST_ENTRIES = 200_000
#: Lets a scan of a table with one sorted file a bucket count as sorted.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z lower-cased."""
    return ascii_lower(strip_blanks(line))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _part(text: Column) -> Column:
    """What tells rows of one id apart; equal values for two texts would do no harm."""
    return F.xxhash64(text)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, part, hash) of every line whose key has ``min_chars`` code points, once for each row of ``docs``."""
    long = F.filter(_lines(F.col("text")), lambda line: F.length(line) >= min_chars)
    keys = F.filter(F.transform(long, line_key), lambda key: F.length(key) >= min_chars)
    hashes = F.array_distinct(F.transform(keys, _hash))
    # Outer, as for an inner one Spark would compute all hashes once more, in a filter on their number.
    return docs.select("doc_id", _part(F.col("text")).alias("part"), F.explode_outer(hashes).alias("hash")).where("hash IS NOT NULL")


class LineRuns:
    """The levelled store. Its runs are bucketed tables on shared storage, sorted by hash."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def counted(self, lines: DataFrame) -> DataFrame:
        """(hash, n_docs, keeper) of a batch of (doc_id, hash), each pair once, without what is settled."""
        counts = lines.repartition(self.buckets, "hash") if self._odd_buckets() else lines
        counts = counts.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        for run in self.runs():
            settled = run.where(F.col("n_docs") >= self.min_docs).select("hash")
            counts = counts.join(settled.hint("merge"), "hash", "left_anti")
        return counts

    def _odd_buckets(self) -> bool:
        return self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, lines: DataFrame) -> None:
        """Count a batch, drop what is settled, and write the rest as a run.

        No document may be in two batches, and batches come in descending order of ids.
        """
        with self.sorted_scans():
            self._put(0, self.counted(lines))

    def _put(self, level: int, entries: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"foliant_run{level}_{uuid.uuid4().hex}"
        writer = entries.select("hash", "n_docs", "keeper").write.bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", new_path(self.spark, name)).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            old = self.levels[level]
            self.levels[level] = []
            self._put(level + 1, self.merged(*[self.spark.table(run) for run in old]))
            self._drop(old)

    @staticmethod
    def merged(left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one, read side by side."""
        right = right.select("hash", F.col("n_docs").alias("more"), F.col("keeper").alias("other"))
        return left.hint("merge").join(right, "hash", "full_outer").select(
            "hash",
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("keeper", "other").alias("keeper"),
        )

    def frequent(self) -> DataFrame:
        """(hash, keeper) of the lines that ``min_docs`` documents hold, from all runs."""
        runs = self.runs()
        whole = runs[0]
        for run in runs[1:]:
            whole = self.merged(whole, run)
        return whole.where(F.col("n_docs") >= self.min_docs).select("hash", "keeper")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def clear(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = []

    def sorted_scans(self) -> _Setting:
        return _Setting(self.spark, SORTED_SCANS, "true")


class _Setting:
    """A session setting for the length of a block, in which all plans that need it are run."""

    def __init__(self, spark: SparkSession, key: str, value: str):
        self.spark, self.key, self.value = spark, key, value

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.key, self.before)


def batch_of(docs: DataFrame, batches: int) -> tuple[Column, int]:
    """The number of the batch of a row, by ranges of ids, the highest first, null ids last; and how many there are."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc_id") > cut, F.lit(i)).otherwise(number)
    return number, len(cuts) + 1


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text without the dropped lines, n_lines, n_dropped."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    number, batches = batch_of(docs, batches)
    path = new_path(spark, "lines")
    line_hashes(docs, min_chars).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, part long, hash binary, batch int").parquet(path)
    # Where ids repeat, a pair of an id and a line may do so too, and must count once.
    repeats = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()

    store = LineRuns(spark, min_docs)
    for batch in range(batches):
        pairs = lines.where(F.col("batch") == batch).select("doc_id", "hash")
        store.add(pairs.distinct() if repeats else pairs)
    with store.sorted_scans():
        frequent = materialise(store.frequent(), "frequent")
    store.clear()

    lost = (
        lines.join(bounded(frequent, BROADCAST_ENTRIES), "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("of"), F.col("part").alias("of_part"))
        .agg(F.collect_set("hash").alias("lost"))
    )
    rows = docs.select("doc_id", "text", _part(F.col("text")).alias("part"))
    own = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    lines = rows.join(lost, own, "left").select("doc_id", _lines(F.col("text")).alias("lines"), "lost")
    gone = lambda line: (F.length(line) >= min_chars) & F.array_contains(F.col("lost"), _hash(line_key(line)))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: ~gone(line)))
    return lines.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        kept.alias("kept"),
    ).select(
        "doc_id",
        F.array_join("kept", "\n").alias("text"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, with a digest in the text's place."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
    FROM documents
), keyed AS (
    SELECT doc_id, n, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
