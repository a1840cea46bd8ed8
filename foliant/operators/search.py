"""Search over texts and vectors, retrieval chunks, prompts and canned chat answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.functions import lexicons as lx
from foliant.functions.text import fixed_windows

#: Query vectors that are compared at once; larger sets go block by block.
QUERIES_PER_BLOCK = 2_000


# --- texts --------------------------------------------------------------------------------------------------


def search_score(text: Column, query: str, kind: str = "keyword") -> Column:
    """100 for an exact occurrence; by keyword 10 for each word of the query that occurs, repeats included."""
    lower, query = F.lower(text), query.lower()
    if kind == "exact":
        return F.when(F.contains(lower, F.lit(query)), 100).otherwise(0)
    return sum((F.when(F.contains(lower, F.lit(w)), 10).otherwise(0) for w in query.split(" ")), F.lit(0))


def search(docs: DataFrame, query: str, kind: str = "keyword", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a score, best first, ties by id."""
    scored = docs.select(id_col, text_col).withColumn("score", search_score(F.col(text_col), query, kind))
    hits = scored.where("score > 0")
    return hits.withColumn("snippet", snippet(F.col(text_col), query)).select(id_col, "score", "snippet")


def snippet(text: Column, query: str, limit: int = 200, around: int = 100) -> Column:
    """The text around the first occurrence of a query, else its beginning, with dots where it is cut."""
    at = F.locate(query.lower(), F.lower(text)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(text), at + len(query) + around)
    found = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), "...").otherwise(""),
    )
    opening = F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, "...").otherwise(""))
    return F.when(at < 0, opening).otherwise(found)


# --- vectors ------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_distance(a: Column, b: Column) -> Column:
    difference = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(difference, F.lit(0.0), lambda s, x: s + x * x)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    measure: str = "cosine",
    least: float | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k best vectors of each query: query_id, neighbour, score (or distance), rank; ties by id.

    Queries are broadcast in blocks of bounded size against all vectors, and each task keeps the best k a query
    before anything is shuffled. ``least`` drops scores below it; a query is not its own neighbour.
    """
    if measure not in ("cosine", "l2"):
        raise ValueError(f"no measure {measure!r}")
    queries = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query"))
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        # The norm is the vector's own, so that only the product is left for each pair.
        part = part.withColumn("query_norm", F.sqrt(dot(F.col("query"), F.col("query"))))
        held = vectors.select(F.col(id_col).alias("neighbour"), F.col(vector_col).alias("vector"))
        held = held.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
        pairs = held.join(F.broadcast(part), F.col("neighbour") != F.col("query_id"))
        if measure == "cosine":
            pairs = pairs.withColumn("score", dot(F.col("vector"), F.col("query")) / (F.col("norm") * F.col("query_norm")))
            order = [F.col("score").desc(), F.col("neighbour")]
            pairs = pairs if least is None else pairs.where(F.col("score") >= least)
        else:
            pairs = pairs.withColumn("score", F.sqrt(squared_distance(F.col("vector"), F.col("query"))))
            order = [F.col("score"), F.col("neighbour")]
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        best = ranked.where(F.col("rank") <= k).select("query_id", "neighbour", "score", "rank")
        found = best if found is None else found.unionByName(best)
    return found


# --- chunks and prompts --------------------------------------------------------------------------------------


def split_recursively(text: str, size: int = 1000, overlap: int = 200, separators=("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that allows it, with overlaps."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    parts = list(text) if mark == "" else text.split(mark)
    chunks: list[str] = []
    held: list[str] = []

    def width(pieces: list[str]) -> int:
        return sum(map(len, pieces)) + len(mark) * max(0, len(pieces) - 1)

    def flush() -> None:
        whole = mark.join(held).strip()
        if whole:
            chunks.append(whole)

    for part in parts:
        if len(part) > size:
            flush()
            held = []
            chunks += split_recursively(part, size, overlap, finer)
            continue
        if held and width([*held, part]) > size:
            flush()
            while held and (width(held) > overlap or width([*held, part]) > size):
                held.pop(0)
        held.append(part)
    flush()
    return chunks


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, chunk) by recursive splitting."""

    @F.arrow_udf("array<string>")
    def chunks(texts: pa.Array) -> pa.Array:
        found = [split_recursively(t or "", size, overlap) for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.string()))

    return docs.select(id_col, chunks(text_col).alias("c")).select(id_col, F.posexplode("c").alias("chunk_id", "chunk"))


def chunk_windows(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, chunk) by fixed windows, without leaving the JVM."""
    found = fixed_windows(F.coalesce(F.col(text_col), F.lit("")), size, overlap)
    return docs.select(id_col, found.alias("c")).select(id_col, F.posexplode_outer("c").alias("chunk_id", "chunk"))


PROMPT = "Contexte:\n%s\n\nQuestion: %s\n\nRéponse:"


def build_prompts(retrieved: DataFrame, question: Column | None = None) -> DataFrame:
    """One prompt a question from its ranked chunks (query_id, rank, chunk[, question])."""
    chunks = F.sort_array(F.collect_list(F.struct("rank", "chunk")))
    gathered = retrieved.groupBy("query_id").agg(chunks.alias("c"), F.first("question").alias("question"))
    context = F.array_join(F.col("c.chunk"), "\n\n")
    return gathered.select("query_id", F.format_string(PROMPT, context, question if question is not None else F.col("question")).alias("prompt"))


def source_preview(chunk: Column, limit: int = 200) -> Column:
    return F.concat(F.substring(chunk, 1, limit), F.lit("..."))


def chat_intent(message: Column) -> Column:
    """summary, words or canned, by what a message contains."""
    lower = F.lower(message)
    return (
        F.when(F.contains(lower, F.lit("résumé")), "summary").when(F.contains(lower, F.lit("mots")), "words").otherwise("canned")
    )


def chat_answer(message: Column, filename: Column, summary: Column, word_count: Column, language: Column) -> Column:
    """The canned answer to a message about a document; without one it asks for one."""
    intent = chat_intent(message)
    about = F.concat(
        F.lit('Voici un résumé du document "'),
        filename,
        F.lit('": '),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("Le résumé est en cours de génération...")),
    )
    counted = F.format_string('Le document "%s" contient %s mots et est en %s.', filename, word_count, language)
    return (
        F.when(filename.isNull(), lx.CHAT_SORRY + lx.CHAT_SELECT)
        .when(intent == "summary", about)
        .when(intent == "words", counted)
        .otherwise(lx.CHAT_SORRY)
    )


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
