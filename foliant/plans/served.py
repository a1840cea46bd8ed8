"""Queries on the served semantics: ingest, language vote, summaries, structure, quality, key terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import entities, language, quality
from foliant.functions import lexicons as lx
from foliant.functions.text import ingest_preview, paragraphs, preprocess, sentences, words
from foliant.operators import summaries
from foliant.plans.registry import joined, n, on, q, r6, s_avg, s_long, s_pieces, s_r6, s_sentences, s_strip, s_words

DOTS = s_pieces("text", r"\.")


@on(
    "documents",
    "doc_stats",
    f"""
    SELECT doc_id, {s_long('length(text)')} AS char_count, {s_long(f"len({s_words('text')})")} AS word_count,
           {s_long(f"len({s_sentences('text')})")} AS sentence_count,
           {s_long(f"len({s_pieces('text', chr(92) + 'n' + chr(92) + 'n')})")} AS paragraph_count,
           {s_long(f"len(list_distinct({s_words('text')}))")} AS distinct_words,
           {s_long("len(list_distinct(string_split(text, '')))")} AS distinct_chars,
           {s_r6(f"len(list_distinct({s_words('text')})) / greatest(len({s_words('text')}), 1)")} AS vocabulary_ratio
    FROM documents
    """,
)
def doc_stats(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    docs = docs.withColumn("words", words(text)).withColumn("n_words", F.size("words"))
    distinct = F.size(F.array_distinct("words"))
    return docs.select(
        "doc_id",
        n(F.length(text)).alias("char_count"),
        n(F.col("n_words")).alias("word_count"),
        n(F.size(sentences(text))).alias("sentence_count"),
        n(F.size(paragraphs(text))).alias("paragraph_count"),
        n(distinct).alias("distinct_words"),
        n(F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))).alias("distinct_chars"),
        r6(distinct / F.greatest(F.col("n_words"), F.lit(1))).alias("vocabulary_ratio"),
    )


CLEAN = s_strip("replace(replace(text, chr(10) || chr(10), chr(10)), chr(13), '')")


@on(
    "documents",
    "mock_ingest",
    f"""
    SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS preview,
           {CLEAN} AS cleaned, {s_long(f"len({s_words(CLEAN)})")} AS word_count
    FROM documents
    """,
)
def mock_ingest(docs: DataFrame) -> DataFrame:
    cleaned = preprocess(F.col("text"))
    return docs.select(
        "doc_id", ingest_preview(F.col("text")).alias("preview"), cleaned.alias("cleaned"), n(F.size(words(cleaned))).alias("word_count")
    )


VOTES = " + ".join(f"CAST(contains(lower(text), {q(w)}) AS INT)" for w in lx.VOTE_WORDS)


@on("documents", "mock_language", f"SELECT doc_id, CASE WHEN {VOTES} > 2 THEN 'fr' ELSE 'en' END AS language FROM documents")
def mock_language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", language.vote(F.col("text")).alias("language"))


LONG_DOTS = f"list_filter({DOTS}, lambda s: length(s) > 10)"


@on(
    "documents",
    "mock_summary",
    f"""
    SELECT doc_id,
           CASE WHEN len({LONG_DOTS}) > 0 THEN array_to_string(list_slice({LONG_DOTS}, 1, 3), '. ') || '.' ELSE {q(lx.NO_SUMMARY)} END AS extractive,
           CASE WHEN len({s_words('text')}) < 50 THEN {q(lx.TOO_SHORT)}
                ELSE replace({q(lx.ABSTRACT)}, '%s', CAST(len({s_words('text')}) AS VARCHAR)) END AS abstractive
    FROM documents
    """,
)
def mock_summary(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", summaries.first_sentences(text).alias("extractive"), summaries.template_summary(text).alias("abstractive"))


BLOCKS = f"len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {s_strip('p')} <> ''))"


@on(
    "documents",
    "mock_structure",
    f"""
    SELECT doc_id, {s_long(f"len({s_words('text')})")} AS word_count, {s_long(f'len({DOTS})')} AS sentence_count,
           {s_long(BLOCKS)} AS paragraph_count,
           CASE WHEN len({DOTS}) > 0 THEN {s_r6(f"round_even(len({s_words('text')}) / len({DOTS}), 2)")} ELSE 0 END AS avg_sentence_length,
           {s_strip('text')} <> '' AS has_title, {BLOCKS} > 1 AS has_paragraphs,
           CAST(greatest(1, CAST(round_even(len({s_words('text')}) / 200, 0) AS INT)) AS VARCHAR) || ' minutes' AS estimated_reading_time
    FROM documents
    """,
)
def mock_structure(docs: DataFrame) -> DataFrame:
    found = quality.served_structure(F.col("text"))
    for name in ("word_count", "sentence_count", "paragraph_count"):
        found[name] = n(found[name])
    found["avg_sentence_length"] = r6(found["avg_sentence_length"])
    return docs.select("doc_id", *[c.alias(name) for name, c in found.items()])


LENGTH = s_avg(f"list_transform({s_words('text')}, lambda w: length(w))")


@on(
    "documents",
    "mock_quality",
    f"""
    SELECT doc_id, {s_r6(f'least(100, greatest(0, 100 - {LENGTH} * 5))')} AS readability_score,
           CASE WHEN {LENGTH} < 5 THEN 'simple' WHEN {LENGTH} < 7 THEN 'medium' ELSE 'complex' END AS complexity,
           {s_long(f"len({s_words('text')})")} AS word_count,
           CASE WHEN len({s_words('text')}) > 100 AND len({DOTS}) > 5 THEN 'good' ELSE 'fair' END AS quality_rating
    FROM documents
    """,
)
def mock_quality(docs: DataFrame) -> DataFrame:
    found = quality.served_quality(F.col("text"))
    found["readability_score"], found["word_count"] = r6(found["readability_score"]), n(found["word_count"])
    return docs.select("doc_id", *[c.alias(name) for name, c in found.items()])


@on(
    "documents",
    "mock_key_terms",
    f"""
    SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_transform(
               list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 4), lambda w: lower(trim(w, '.,!?;:'))))), 1, 10), '|') AS key_terms,
           {s_long(f"len(list_distinct({s_words('text')}))")} AS word_frequency, {s_long('length(text)')} AS character_count
    FROM documents
    """,
)
def mock_key_terms(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        joined(entities.key_terms(text)).alias("key_terms"),
        n(F.size(F.array_distinct(words(text)))).alias("word_frequency"),
        n(F.length(text)).alias("character_count"),
    )


@on(
    "documents",
    "summary_response",
    f"""
    WITH s AS (SELECT doc_id, text, CASE WHEN len({LONG_DOTS}) > 0 THEN array_to_string(list_slice({LONG_DOTS}, 1, 3), '. ') || '.'
                                         ELSE {q(lx.NO_SUMMARY)} END AS summary FROM documents)
    SELECT doc_id, {s_long('length(text)')} AS original_length, {s_long('length(summary)')} AS summary_length,
           {s_r6('length(summary) / nullif(length(text), 0)')} AS compression_ratio FROM s
    """,
)
def summary_response(docs: DataFrame) -> DataFrame:
    found = summaries.summary_response(docs, "extractive")
    ratio = summaries.compression(F.col("extractive_summary"), F.col("text"))
    return found.select("doc_id", n(F.col("original_length")).alias("original_length"), n(F.col("summary_length")).alias("summary_length"), r6(ratio).alias("compression_ratio"))


