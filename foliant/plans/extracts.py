"""Queries on the pieces that documents are built of and reported in: pages, paragraphs, properties, fallbacks, summaries.

The tables have no pages or paragraphs, so a document's lines stand for its blocks, each of a kind by its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, language
from foliant.functions import lexicons as lx
from foliant.functions.text import coverage, french_share, looks_arabic, looks_french, word_set
from foliant.operators import documents, summaries
from foliant.plans import languages  # noqa: F401  its SQL is used below
from foliant.plans.registry import SQL, on, pattern, q, r6, register, s_count, s_r6, s_strip, s_words, table
from foliant.sources import sinks

LINES = "string_split(text, chr(10))"


def _kind(names: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i % len(names))


def _blocks(names: list[str]) -> Column:
    return F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(s.alias("text"), _kind(names, i).alias("type")))


BLOCKS = ["header", "body", "list", "footer", "table"]
PAGE_PARTS = ", ".join(
    f"list_transform(list_filter(blocks, lambda b: b.type = {q(kind)}), lambda b: {q(before)} || b.text || {after})"
    for kind, before, after in (
        ("header", "# ", "chr(10)"),
        ("body", "", "chr(10)"),
        ("list", "", "chr(10)"),
        ("table", "[TABLE]\n", "chr(10) || '[/TABLE]' || chr(10)"),
    )
)


def s_list_concat(parts: str) -> str:
    return f"flatten([{parts}])"


@on(
    "documents",
    "page_text",
    f"""
    WITH b AS (SELECT doc_id, list_transform({LINES}, lambda s, i: {{'text': s, 'type': {BLOCKS}[(i - 1) % 5 + 1]}}) AS blocks FROM documents)
    SELECT doc_id, {s_strip(f"array_to_string({s_list_concat(PAGE_PARTS)}, chr(10))")} AS formatted,
           {s_strip("array_to_string(list_transform(blocks, lambda b: b.text), chr(10))")} AS plain
    FROM b
    """,
)
def page_text(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", _blocks(BLOCKS).alias("blocks"))
    return docs.select(
        "doc_id", documents.page_text(F.col("blocks")).alias("formatted"), documents.page_text(F.col("blocks"), False).alias("plain")
    )


@on(
    "documents",
    "pages_text",
    f"""
    SELECT doc_id, array_to_string(list_transform({LINES}, lambda s, i: chr(10) || '--- Page ' || i || ' ---' || chr(10) || s), '') AS whole FROM documents
    """,
)
def pages_text(docs: DataFrame) -> DataFrame:
    pages = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct((i + 1).alias("number"), s.alias("text")))
    return docs.select("doc_id", documents.pages_text(pages).alias("whole"))


ELEMENTS = ["heading", "paragraph", "list_item", "table"]


@on(
    "documents",
    "word_text",
    f"""
    SELECT doc_id, array_to_string(list_transform({LINES}, lambda s, i: CASE (i - 1) % 4 WHEN 0 THEN repeat('#', CAST((i - 1) % 3 + 1 AS INT)) || ' ' || s || chr(10) || chr(10)
           WHEN 2 THEN '• ' || s || chr(10) WHEN 3 THEN s || chr(10) ELSE s || chr(10) || chr(10) END), '') AS whole
    FROM documents
    """,
)
def word_text(docs: DataFrame) -> DataFrame:
    elements = F.transform(
        F.split("text", "\n", -1),
        lambda s, i: F.struct(_kind(ELEMENTS, i).alias("type"), s.alias("text"), (i % 3 + 1).alias("heading_level")),
    )
    return docs.select("doc_id", documents.word_text(elements).alias("whole"))


STRIPPED = f"length({s_strip('text')})"


@on(
    "documents",
    "extraction_states",
    f"""
    SELECT doc_id, {STRIPPED} < 100 AND doc_id % 3 > 0 AS is_scanned, CASE WHEN {STRIPPED} < 100 AND doc_id % 3 > 0 THEN 0.9 ELSE 0.8 END AS confidence,
           CASE WHEN doc_id % 11 >= 8 THEN 'success' WHEN doc_id % 11 >= 5 THEN 'partial' ELSE 'failed' END AS extraction_status,
           CASE WHEN {STRIPPED} > 100 THEN 'success' WHEN {STRIPPED} > 0 THEN 'partial' ELSE 'failed' END AS word_status
    FROM documents
    """,
)
def extraction_states(docs: DataFrame) -> DataFrame:
    scanned = documents.is_scanned(F.col("text"), F.col("doc_id") % 3)
    return docs.select(
        "doc_id",
        scanned["is_scanned"].alias("is_scanned"),
        scanned["confidence"].cast("double").alias("confidence"),
        documents.extraction_status(F.col("doc_id") % 11 / 10).alias("extraction_status"),
        documents.word_status(F.col("text")).alias("word_status"),
    )


@on(
    "documents",
    "mixed_scripts",
    f"""
    WITH s AS ({SQL['script_shares']})
    SELECT doc_id, coalesce(CAST(latin > .3 AS INT), 0) + coalesce(CAST(arabic > .3 AS INT), 0) + coalesce(CAST(other > .3 AS INT), 0) >= 2 AS mixed,
           {s_r6(f"{s_count('text', '[' + lx.ACCENTED_FR + 'a-zA-Z]')} / nullif({s_count('text', '[^ ' + chr(92) + 't-' + chr(92) + 'r]')}, 0)")} AS french_share
    FROM s JOIN documents USING (doc_id)
    """,
)
def mixed_scripts(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    share = F.when(F.regexp_count(text, F.lit(r"[^ \t-\r]")) > 0, french_share(text))
    return docs.select("doc_id", language.is_mixed(text).alias("mixed"), r6(share).alias("french_share"))


LATIN_LETTERS = s_count("text", "[" + lx.ACCENTED_FR + "a-zA-Z]")
ARABIC_LETTERS = s_count("text", r"[\x{0600}-\x{06FF}]")
VISIBLE = f"nullif({s_count('text', '[^ ' + chr(92) + 't-' + chr(92) + 'r]')}, 0)"


@on(
    "documents",
    "script_guards",
    f"""
    SELECT doc_id, coalesce({LATIN_LETTERS} / {VISIBLE} > 0.3, false) AS french, coalesce({ARABIC_LETTERS} / {VISIBLE} > 0.1, false) AS arabic FROM documents
    """,
)
def script_guards(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", looks_french(F.col("text")).alias("french"), looks_arabic(F.col("text")).alias("arabic"))


@on(
    "documents",
    "ocr_languages",
    rf"""
    WITH c AS (SELECT doc_id, {s_count('text', '[a-zA-ZÀ-ÿ]')} AS f, {s_count("repeat('م', CAST(doc_id % 40 AS INT)) || text[1:20]", '[' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}]')} AS a FROM documents)
    SELECT doc_id, CASE WHEN a > f THEN 'arabic' WHEN f > a THEN 'french' ELSE 'mixed' END AS language FROM c
    """,
)
def ocr_languages(docs: DataFrame) -> DataFrame:
    second = F.concat(F.repeat(F.lit("م"), (F.col("doc_id") % 40).cast("int")), F.substring("text", 1, 20))
    return docs.select("doc_id", language.ocr_language(F.col("text"), second).alias("language"))


def s_word_set(t: str) -> str:
    return f"list_distinct({s_words(f'lower({t})')})"


HALVES = "SELECT doc_id, text[1:200] AS a, text[101:400] AS b, text FROM documents"
TAKEN = f"coalesce(len(list_intersect({s_word_set('a')}, {s_word_set('b')})) / nullif(len({s_word_set('a')}), 0), 0)"


def _halves(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.substring("text", 1, 200).alias("a"), F.substring("text", 101, 300).alias("b"), "text")


@on("documents", "word_coverage", f"SELECT doc_id, {s_r6(TAKEN)} AS coverage FROM ({HALVES})")
def word_coverage(docs: DataFrame) -> DataFrame:
    return _halves(docs).select("doc_id", r6(coverage(word_set(F.col("a")), word_set(F.col("b")))).alias("coverage"))


IN_TEXT = f"coalesce(len(list_intersect({s_word_set('a')}, {s_word_set('text')})) / nullif(len({s_word_set('a')}), 0), 0)"


@on(
    "documents",
    "summary_quality",
    f"""
    SELECT doc_id, {s_r6(f"(doc_id % 10) / 10 * 0.5 + {IN_TEXT} * 0.3 + coalesce(least(1.0, 0.3 / nullif(length(a) / nullif(length(text), 0), 0)), 0) * 0.2")} AS quality,
           CASE WHEN (doc_id % 7) / 7.3 * 0.7 - coalesce(abs(length(a) - length(text) * 0.2) / nullif(length(text) * 0.2, 0), 0) * 0.1
                   > (doc_id % 5) / 5.1 * 0.6 - coalesce(abs(length(b) - length(text) * 0.2) / nullif(length(text) * 0.2, 0), 0) * 0.1 THEN 'a' ELSE 'b' END AS better
    FROM ({HALVES})
    """,
)
def summary_quality(docs: DataFrame) -> DataFrame:
    """The parts of the score before it is cut to three places, and which of two stretches makes the better summary."""
    docs = _halves(docs)
    share = lambda k, of: F.col("doc_id") % k / of
    better = summaries.better_summary(F.col("text"), F.col("a"), F.col("b"), share(7, 7.3), share(5, 5.1))
    chosen = F.when((better == F.col("a")) & (F.col("a") != F.col("b")), "a").otherwise("b")
    return docs.select(
        "doc_id", r6(summaries.summary_quality(share(10, 10), F.col("a"), F.col("text"), places=None)).alias("quality"), chosen.alias("better")
    )


@on(
    "documents",
    "export_summary",
    """
    SELECT doc_id, array_to_string(['Résumé du document: doc-' || doc_id, '', 'RÉSUMÉ EXTRACTIF:', CASE WHEN text = '' THEN 'Non disponible' ELSE text[1:80] END, '', 'RÉSUMÉ ABSTRACTIF:',
        'Non disponible', '', 'STATISTIQUES:', '- Nombre de mots: ' || n_chars, '- Langue détectée: ' || lang, '- Date d''ajout: ' || strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INT), '%d/%m/%Y')], chr(10)) AS report
    FROM documents
    """,
)
def export_summary(docs: DataFrame) -> DataFrame:
    added = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    report = summaries.export_summary(name, F.substring("text", 1, 80), F.lit(None).cast("string"), F.col("n_chars"), F.col("lang"), added)
    return docs.select("doc_id", report.alias("report"))


@on(
    "documents",
    "properties",
    """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'title ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN 'creator' WHEN doc_id % 3 = 0 THEN lang END AS author,
           source AS subject, CASE WHEN doc_id % 4 = 0 THEN 'later' ELSE 'sooner' END AS creation_date, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS merged_lang, 'b' AS merged_own
    FROM documents
    """,
)
def properties(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    entries = F.create_map(
        F.lit("title"), F.when(i % 2 == 0, F.concat(F.lit("title "), i.cast("string"))).otherwise(F.lit("")),
        F.lit("author"), F.when(i % 3 == 0, F.col("lang")),
        F.lit("creator"), F.when(i % 5 == 0, F.lit("creator")).otherwise(F.lit("")),
        F.lit("subject"), F.col("source"),
        F.lit("creation_date"), F.lit("sooner"),
        F.lit("creationDate"), F.when(i % 4 == 0, F.lit("later")),
    )
    found = documents.map_properties(entries)
    first = F.create_map(F.lit("lang"), F.lit("first"), F.lit("own"), F.lit("a"))
    second = F.create_map(F.lit("lang"), F.when(i % 7 != 0, F.col("lang")), F.lit("own"), F.lit("b"))
    merged = documents.merge_maps(first, F.lit(None).cast("map<string,string>"), second)
    return docs.select(
        "doc_id",
        *[found[name].alias(name) for name in ("title", "author", "subject", "creation_date")],
        merged["lang"].alias("merged_lang"),
        merged["own"].alias("merged_own"),
    )


TRIES = """
    SELECT doc_id, text[1:CAST(doc_id % 90 AS INT)] AS text, CASE doc_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status, true AS first, 0 AS k FROM documents
    UNION ALL SELECT doc_id, text[1:100], 'partial', false, 1 FROM documents
    UNION ALL SELECT doc_id, text[1:60], CASE WHEN doc_id % 2 = 0 THEN 'success' ELSE 'failed' END, false, 2 FROM documents
"""


@on(
    "documents",
    "best_fallback",
    f"""
    SELECT doc_id, text, status, CASE WHEN first THEN 'native' ELSE 'fallback' END AS extraction_method FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first AND NOT (status = 'failed' AND length(text) < 50) DESC, status = 'success' DESC, length(text) DESC) AS rank
        FROM ({TRIES})) WHERE rank = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 100)
    """,
)
def best_fallback(docs: DataFrame) -> DataFrame:
    docs = docs.where(F.length("text") > 100)
    i = F.col("doc_id")

    def tried(size: Column, status: Column, primary: bool) -> DataFrame:
        return docs.select("doc_id", F.substring(F.col("text"), F.lit(1), size).alias("text"), status.alias("status"), F.lit(primary).alias("primary"))

    first = F.when(i % 3 == 0, "failed").when(i % 3 == 1, "partial").otherwise("success")
    results = tried((i % 90).cast("int"), first, True)
    results = results.unionByName(tried(F.lit(100), F.lit("partial"), False))
    results = results.unionByName(tried(F.lit(60), F.when(i % 2 == 0, "success").otherwise("failed"), False))
    return documents.best_fallback(results)


@register(
    "registry_add",
    """
    WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'file ' || doc_id % 300 AS filename, doc_id FROM documents),
    a AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) AS rank FROM docs WHERE doc_id % 2 = 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) AS rank FROM docs WHERE doc_id % 2 = 1)
    SELECT id, filename, CASE WHEN rank = 1 THEN 'stored' ELSE 'turned away' END AS outcome FROM a
    UNION ALL SELECT id, filename, CASE WHEN rank = 1 AND filename NOT IN (SELECT filename FROM a) THEN 'stored' ELSE 'turned away' END FROM b
    """,
)
def registry_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into an empty registry: what it stored, and what it turned away."""
    from foliant.plans.tables import _scratch

    registry = sinks.DocumentRegistry(spark, _scratch(spark, "registry"))
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        i.cast("string").alias("id"),
        F.concat(F.lit("file "), (i % 300).cast("string")).alias("filename"),
        "text",
        F.col("lang").alias("language"),
        F.col("n_chars").cast("int").alias("word_count"),
        F.timestamp_seconds(i).alias("upload_date"),
    )
    away = [registry.add(docs.where(i % 2 == half)).select("id", "filename") for half in (0, 1)]
    stored = registry.listing().select("id", "filename", F.lit("stored").alias("outcome"))
    return stored.unionByName(away[0].unionByName(away[1]).withColumn("outcome", F.lit("turned away")))


MARKS = ("  - ", "12) ", "Chapitre 4 ", "Source: ", "Table des matières ", "")
MARKED = f"""
    SELECT doc_id, [{', '.join(map(q, MARKS))}][doc_id % 6 + 1] || text[1:60] AS text, CAST(doc_id % 13 = 0 AS INT) AS level,
           CASE WHEN doc_id % 17 = 0 THEN 'Heading 2' ELSE 'Normal' END AS style
    FROM documents
"""


@on(
    "documents",
    "paragraph_types",
    rf"""
    WITH p AS (SELECT doc_id, text, level, style, {s_strip('lower(text)')} AS l, {s_strip('text')} AS s FROM ({MARKED}))
    SELECT doc_id, CASE WHEN level > 0 OR contains(lower(style), 'heading') THEN 'heading'
        WHEN {' OR '.join(f'regexp_matches(s, {pattern(p, True)})' for p in lx.PARAGRAPH_HEADINGS)} THEN 'heading'
        WHEN regexp_matches(text, '^(?:\s*[-•▪▫◦‣⁃*]\s+|\s*\d+[.)]\s+|\s*[a-zA-Z][.)]\s+)') THEN 'list_item'
        WHEN contains(l, 'table') AND (contains(l, 'contents') OR contains(l, 'matières')) THEN 'toc'
        WHEN regexp_matches(l, '^(?:ref:|référence:|source:)') THEN 'reference' ELSE 'body' END AS kind
    FROM p
    """,
)
def paragraph_types(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    marks = F.array(*map(F.lit, MARKS))
    text = F.concat(F.get(marks, (i % 6).cast("int")), F.substring("text", 1, 60))
    style = F.when(i % 17 == 0, "Heading 2").otherwise("Normal")
    return docs.select("doc_id", classify.paragraph_type(text, style, (i % 13 == 0).cast("int")).alias("kind"))

