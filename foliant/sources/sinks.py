"""Writing results: JSON, XML, manifests, a document registry and a vector store.

Stores are Parquet tables on shared storage. A change writes a new version beside the old one and then names it in a
one-row pointer, so readers see one or the other, and a failed write leaves the old version in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def analysis_json(analysis: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One JSON string a document."""
    fields = [c for c in analysis.columns if c != id_col]
    return analysis.select(id_col, F.to_json(F.struct(*fields)).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_batch(results: DataFrame, path: str) -> None:
    """The results of a batch as JSON lines, and their counts beside them."""
    from foliant.operators.documents import batch_info

    results.write.mode("overwrite").json(f"{path}/document_analyses")
    batch_info(results).write.mode("overwrite").json(f"{path}/batch_info")


def to_xml(fields: dict[str, Column], root: str = "document_metadata") -> Column:
    """Fields as XML elements in their order; values are not escaped, lists become items, nulls ``None``."""

    def element(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("None")), F.lit(f"</{name}>"))

    body = F.concat(*[element(name, value) for name, value in fields.items()])
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>'), body, F.lit(f"</{root}>"))


def xml_items(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("<item>"), v.cast("string"), F.lit("</item>"))), "")


# --- manifests --------------------------------------------------------------------------------------------


def create_manifest(files: DataFrame) -> DataFrame:
    """An entry for each validated file (path, is_valid, errors), in the order of paths."""
    return files.select(
        F.col("path"),
        F.lit(False).alias("processed"),
        F.lit(0.0).alias("processing_time"),
        F.array().cast("array<string>").alias("output_files"),
        F.struct("is_valid", "errors").alias("validation"),
    )


def update_manifest(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Entries with the results (path, processing_time, output_files) of those that have any."""
    done = results.select(
        F.col("path").alias("done_path"),
        F.col("processing_time").alias("took"),
        F.col("output_files").alias("made"),
    )
    return manifest.join(done, F.col("path") == F.col("done_path"), "left").select(
        "path",
        (F.col("processed") | F.col("done_path").isNotNull()).alias("processed"),
        F.coalesce("took", "processing_time").alias("processing_time"),
        F.coalesce("made", "output_files").alias("output_files"),
        "validation",
    )


# --- stores -----------------------------------------------------------------------------------------------


class Table:
    """A Parquet table under a folder, replaced version by version."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _current(self) -> str | None:
        fs = self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        pointer = f"{self.folder}/CURRENT"
        if not fs.exists(self._path(pointer)):
            return None
        return self.spark.read.text(pointer).first()["value"]

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def read(self) -> DataFrame:
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}")

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.read().columns).write.parquet(f"{self.folder}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/CURRENT")

    def append(self, rows: DataFrame) -> None:
        """Add rows: to the files of the current version, or as the first one."""
        version = self._current()
        if version is None:
            self.replace(rows)
        else:
            rows.select(*self.read().columns).write.mode("append").parquet(f"{self.folder}/{version}")


class DocumentRegistry:
    """Stored documents by id. A file name can be stored once."""

    SCHEMA = "id string, filename string, text string, language string, word_count int, upload_date timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Table(spark, folder, self.SCHEMA)

    def add(self, docs: DataFrame) -> DataFrame:
        """Store the documents whose names are new; returns all rows that were turned away.

        Of new rows with one name the earliest is stored, by date, then id, then text; rows that agree in all of these are ties.
        """
        held = self.table.read().select("filename").distinct()
        known, order = docs.join(held, "filename", "left_semi"), F.struct("upload_date", "id", "text")
        new = docs.join(held, "filename", "left_anti")
        # Combined in each task, so a name that very many rows share is a row a task; only its ties are numbered.
        first = new.groupBy(F.col("filename").alias("name")).agg(F.min(order).alias("first"))
        marked = new.join(first, F.col("filename") == F.col("name"))
        tie = F.row_number().over(Window.partitionBy("filename").orderBy(F.lit(0)))
        ties = marked.where(order == F.col("first")).withColumn("tie", tie)
        self.table.append(ties.where("tie = 1").select(docs.columns))
        late = marked.where(order != F.col("first")).select(docs.columns)
        return known.select(docs.columns).unionByName(late).unionByName(ties.where("tie > 1").select(docs.columns))

    def all(self) -> DataFrame:
        return self.table.read()

    def listing(self) -> DataFrame:
        return self.all().select("id", "filename", "language", "word_count", "upload_date")

    def get(self, doc_id: str) -> DataFrame:
        return self.all().where(F.col("id") == doc_id)

    def delete(self, doc_id: str) -> bool:
        held = self.all()
        if held.where(F.col("id") == doc_id).isEmpty():
            return False
        self.table.replace(held.where(F.col("id") != doc_id))
        return True

    def health(self) -> DataFrame:
        return self.all().agg(F.lit("healthy").alias("status"), F.count("*").alias("documents_count"))


class VectorStore:
    """Chunks with their vectors and metadata; search is ``foliant.operators.search.nearest``."""

    SCHEMA = "chunk_id string, doc_id string, chunk string, metadata map<string,string>, embedding array<float>"

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Table(spark, folder, self.SCHEMA)

    def add_documents(self, docs: DataFrame, size: int = 1000, overlap: int = 200) -> None:
        """Chunk, embed and append documents (doc_id, text[, metadata])."""
        from foliant.operators.models import embed
        from foliant.operators.search import chunk_documents

        chunks = embed(chunk_documents(docs.withColumn("doc_id", F.col("doc_id").cast("string")), size, overlap), "chunk")
        if "metadata" in docs.columns:
            parents = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "metadata")
            chunks = chunks.join(parents, "doc_id", "left")
        else:
            chunks = chunks.withColumn("metadata", F.create_map().cast("map<string,string>"))
        key = F.concat_ws("-", F.col("doc_id"), F.col("chunk_id").cast("string"))
        self.table.append(chunks.withColumn("chunk_id", key))

    def search(self, queries: DataFrame, k: int = 5, least: float | None = 0.5) -> DataFrame:
        """The best chunks for queries (query_id, question): similarity, distance and rank."""
        from foliant.operators.models import embed
        from foliant.operators.search import nearest

        asked = embed(queries, "question").select(F.concat(F.lit("?"), F.col("query_id")).alias("chunk_id"), "embedding")
        held = self.table.read()
        found = nearest(held, asked, k, "cosine", least, "chunk_id", "embedding")
        return found.join(held, F.col("neighbour") == F.col("chunk_id")).select(
            F.expr("substring(query_id, 2)").alias("query_id"),
            "chunk_id",
            "chunk",
            "metadata",
            F.col("score").alias("similarity"),
            (1 - F.col("score")).alias("distance"),
            "rank",
        )

    def count(self) -> int:
        return self.table.read().count()
