"""Queries on classification, titles, counters, entities and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, entities, language
from foliant.functions import lexicons as lx
from foliant.operators import documents
from foliant.plans.languages import BASIC_N, FRAR, LATIN_FR_N
from foliant.plans.registry import (
    joined,
    n,
    on,
    pattern,
    q,
    r6,
    register,
    s_count,
    s_first_best,
    s_literal,
    s_long,
    s_pieces,
    s_r6,
    s_strip,
    s_words,
    table,
)

WITH_LANGUAGE = f"SELECT doc_id, text, lower(text) AS t, {FRAR} AS language FROM (SELECT doc_id, text, {BASIC_N} AS a, {LATIN_FR_N} AS l FROM documents)"


def s_keywords(lexicon, fold: bool, weight: int = 1) -> dict[str, str]:
    t = "t" if fold else "text"
    return {name: f"{weight} * ({' + '.join(s_literal(t, w.lower() if fold else w) for w in terms)})" for name, terms in lexicon.items()}


def s_patterns(lexicon, weight: int = 1) -> dict[str, str]:
    return {name: f"{weight} * ({' + '.join(s_count('text', p, True) for p in terms)})" for name, terms in lexicon.items()}


def s_sum(*parts: dict[str, str]) -> dict[str, str]:
    return {name: " + ".join(f"({p[name]})" for p in parts) for name in parts[0]}


FR_SCORES = s_sum(s_keywords(lx.TYPE_KEYWORDS_FR, True, 2), s_patterns(lx.TYPE_PATTERNS_FR, 3))
AR_SCORES = s_sum(s_keywords(lx.TYPE_KEYWORDS_AR, False, 2), s_patterns(lx.TYPE_PATTERNS_AR, 3))
MIXED_SCORES = s_sum(s_keywords(lx.TYPE_KEYWORDS_FR, False, 2), s_patterns(lx.TYPE_PATTERNS_FR, 3), AR_SCORES)


def s_by_language(scores: dict[str, dict[str, str]]) -> str:
    """One score column a class, by the language of the row."""
    names = list(scores["fr"])
    return ", ".join(
        f"CASE language WHEN 'ar' THEN {scores['ar'][c]} WHEN 'mixed' THEN {scores['mixed'][c]} ELSE {scores['fr'][c]} END AS {c}" for c in names
    )


TYPES = list(lx.TYPE_KEYWORDS_FR)


@on(
    "documents",
    "doc_type_lexicon",
    f"""
    WITH s AS (SELECT doc_id, {s_by_language({'fr': FR_SCORES, 'ar': AR_SCORES, 'mixed': MIXED_SCORES})} FROM ({WITH_LANGUAGE}))
    SELECT doc_id, {s_first_best({c: c for c in TYPES})} AS type_document,
           {s_r6(f"coalesce(greatest({', '.join(TYPES)}) * 100.0 / nullif({' + '.join(TYPES)}, 0), 0)")} AS confidence
    FROM s
    """,
)
def doc_type_lexicon(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", language.french_or_arabic(F.col("text")).alias("language"))
    docs = docs.withColumn("found", classify.document_type(F.col("text"), F.col("language")))
    return docs.select("doc_id", F.col("found.type").alias("type_document"), r6(F.col("found.confidence")).alias("confidence"))


SECTORS = list(lx.SECTORS_FR)
SECTOR_SCORES = {
    "fr": s_keywords(lx.SECTORS_FR, True),
    "ar": s_keywords(lx.SECTORS_AR, False),
    "mixed": s_sum(s_keywords(lx.SECTORS_FR, False), s_keywords(lx.SECTORS_AR, False)),
}


@on(
    "documents",
    "sector",
    f"""
    WITH s AS (SELECT doc_id, {s_by_language(SECTOR_SCORES)} FROM ({WITH_LANGUAGE}))
    SELECT doc_id, CASE WHEN greatest({', '.join(SECTORS)}) > 0 THEN {s_first_best({c: c for c in SECTORS})} ELSE {q(lx.SECTOR_DEFAULT)} END AS secteur
    FROM s
    """,
)
def sector(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", language.french_or_arabic(F.col("text")).alias("language"))
    return docs.select("doc_id", classify.sector(F.col("text"), F.col("language")).alias("secteur"))


def s_classes(lexicon, out: str) -> str:
    scores = {name: f"s{i}" for i, name in enumerate(lexicon)}
    columns = ", ".join(f"{score} AS s{i}" for i, score in enumerate(s_patterns(lexicon).values()))
    return f"SELECT doc_id, {s_first_best(scores)} AS {out} FROM (SELECT doc_id, {columns} FROM documents)"


@on("documents", "doc_type_patterns", s_classes(lx.METADATA_TYPES, "document_type"))
def doc_type_patterns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.metadata_type(F.col("text")).alias("document_type"))


@on("documents", "doc_category", s_classes(lx.METADATA_CATEGORIES, "document_category"))
def doc_category(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.metadata_category(F.col("text")).alias("document_category"))


@on("documents", "department", s_classes(lx.METADATA_DEPARTMENTS, "ministry_department"))
def department(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.metadata_department(F.col("text")).alias("ministry_department"))


STATUS = " ".join(f"WHEN regexp_matches(text, {pattern(p, True)}) THEN {q(name)}" for name, p in lx.STATUSES.items())


@on("documents", "doc_status", f"SELECT doc_id, CASE {STATUS} ELSE 'unknown' END AS status FROM documents")
def doc_status(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.status(F.col("text")).alias("status"))


LEXICON = [(name, i, term, 1) for i, (name, terms) in enumerate(lx.SECTORS_FR.items()) for term in terms]
LEXICON_VALUES = ", ".join(f"({q(c)}, {i}, {q(t.lower())}, {w})" for c, i, t, w in LEXICON)


@register(
    "classify_with_lexicon",
    f"""
    WITH lexicon(class, ord, term, weight) AS (VALUES {LEXICON_VALUES}),
    s AS (SELECT doc_id, class, ord, sum((length(lower(text)) - length(replace(lower(text), term, ''))) / length(term) * weight) AS score
          FROM documents JOIN lexicon ON contains(lower(text), term) GROUP BY doc_id, class, ord)
    SELECT doc_id, class, {s_r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM s) WHERE n = 1
    """,
)
def classify_with_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "class string, ord int, term string, weight int")
    found = classify.classify_with(table(spark, sf_dir, "documents"), lexicon)
    return found.withColumn("score", r6(F.col("score")))


def s_total(patterns) -> str:
    return " + ".join(s_count("text", p, True) for p in patterns)


@on(
    "documents",
    "structure_counters",
    f"""
    SELECT doc_id, regexp_matches(text, {pattern('|'.join(lx.TOC_PATTERNS), True)}) AS has_toc, {s_long(s_total(lx.SECTION_PATTERNS))} AS section_count,
           {s_long(s_total(lx.TABLE_PATTERNS))} AS table_count, {s_long(s_total(lx.FIGURE_PATTERNS))} AS figure_count,
           {s_long(s_total(lx.REFERENCE_PATTERNS))} AS reference_count
    FROM documents
    """,
)
def structure_counters(docs: DataFrame) -> DataFrame:
    found = classify.structure_counters(F.col("text"))
    return docs.select("doc_id", found.pop("has_toc").alias("has_toc"), *[n(c).alias(name) for name, c in found.items()])


LINES = f"list_transform(string_split(text, chr(10)), lambda s: {s_strip('s')})"
TITLE_LIKE = (
    r"((CAST(upper(s) = s AND regexp_matches(s, '\p{Lu}') AS INT)) + CAST(len(" + s_words("s") + ") < 15 AS INT) + CAST(NOT ends_with(s, '.') AS INT)"
    r" + CAST(NOT regexp_matches(s, '^\d+\.') AS INT) + CAST(NOT starts_with(s, 'Page ') AS INT) + CAST(NOT starts_with(s, 'صفحة ') AS INT)) >= 3"
)


@on(
    "documents",
    "doc_title",
    f"""
    SELECT doc_id, coalesce(list_filter(list_slice({LINES}, 1, 10), lambda s: length(s) >= 10 AND {TITLE_LIKE})[1],
                            list_filter(list_slice({LINES}, 1, 5), lambda s: length(s) BETWEEN 20 AND 200)[1], '') AS title
    FROM documents
    """,
)
def doc_title(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.title(F.col("text")).alias("title"))


VERSIONS = ", ".join(f"nullif(regexp_extract(text, {pattern(p, True)}, 1), '')" for p in lx.VERSION_PATTERNS)


@on("documents", "doc_version", f"SELECT doc_id, coalesce({VERSIONS}, '') AS version FROM documents")
def doc_version(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", classify.version(F.col("text")).alias("version"))


# --- entities ---------------------------------------------------------------------------------------------


def s_matches(patterns, ignore_case: bool) -> str:
    found = [f"regexp_extract_all(text, {pattern(p, ignore_case)}, {group})" for p, group in patterns]
    return "flatten([" + ", ".join(found) + "])"


def s_entities(french, arabic, keep: str = "true") -> str:
    fr = f"CASE WHEN language IN ('fr', 'mixed') THEN {s_matches(french, True)} ELSE [] END"
    ar = f"CASE WHEN language IN ('ar', 'mixed') THEN {s_matches(arabic, False)} ELSE [] END"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_concat({fr}, {ar}), lambda x: {keep}))), '|')"


@on(
    "documents",
    "entities",
    f"""
    SELECT doc_id, {s_entities(lx.DATES_FR, lx.DATES_AR, 'length(trim(x)) > 3')} AS dates, {s_entities(lx.REFERENCES_FR, lx.REFERENCES_AR)} AS refs,
           {s_entities(lx.PLACES_FR, lx.PLACES_AR)} AS places
    FROM ({WITH_LANGUAGE})
    """,
)
def entity_lists(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    docs = docs.select("doc_id", "text", language.french_or_arabic(text).alias("language"))
    lang = F.col("language")
    return docs.select(
        "doc_id",
        joined(entities.dates(text, lang)).alias("dates"),
        joined(entities.references(text, lang)).alias("refs"),
        joined(entities.places(text, lang)).alias("places"),
    )


@on(
    "documents",
    "batch_summary",
    f"""
    WITH r AS (SELECT {FRAR} <> 'unknown' AS good FROM (SELECT {BASIC_N} AS a, {LATIN_FR_N} AS l FROM documents))
    SELECT count(*) AS total_documents, count(*) FILTER (WHERE good) AS successful_analyses, count(*) FILTER (WHERE NOT good) AS failed_analyses,
           {s_r6('count(*) FILTER (WHERE good) * 100.0 / count(*)')} AS success_rate
    FROM r
    """,
)
def batch_summary(docs: DataFrame) -> DataFrame:
    status = F.when(language.french_or_arabic(F.col("text")) != "unknown", "success").otherwise("error")
    return documents.batch_info(docs.select(status.alias("processing_status"))).withColumn("success_rate", r6(F.col("success_rate")))


# --- keywords ---------------------------------------------------------------------------------------------

WORD_FR = "[a-zA-Zàâäéèêëïîôöùûüç]"
S_FRENCH = rf"""list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'),
                   lambda w: regexp_full_match(w, '{WORD_FR}{{3,}}') AND NOT list_contains([{', '.join(q(w) for w in lx.FRENCH_STOP_KEYWORDS)}], w))"""
S_ARABIC = rf"""list_filter(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]{{3,}}'),
                   lambda w: NOT list_contains([{', '.join(q(w) for w in lx.ARABIC_STOP_KEYWORDS)}], w))"""


@on(
    "documents",
    "top_keywords",
    f"""
    WITH f AS (SELECT doc_id, CASE language WHEN 'fr' THEN {S_FRENCH} WHEN 'ar' THEN {S_ARABIC} WHEN 'mixed' THEN list_concat({S_ARABIC}, {S_FRENCH}) END AS ws FROM ({WITH_LANGUAGE})),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM f),
    c AS (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM w GROUP BY doc_id, word)
    SELECT doc_id, word, n, rank FROM c WHERE rank <= 10
    """,
)
def top_keywords(docs: DataFrame) -> DataFrame:
    """A document is a row, so its keywords are counted and ranked in that row; nothing is shuffled."""
    docs = docs.select("doc_id", "text", language.french_or_arabic(F.col("text")).alias("language"))
    found = docs.select("doc_id", entities.ranked_keywords(F.col("text"), F.col("language")).alias("found"))
    return _ranked(found).select("doc_id", "word", "n", F.col("place").alias("rank"))


def _ranked(found: DataFrame) -> DataFrame:
    """(doc_id, word, n, place) from (doc_id, found). Outer, as for an inner explode Spark would compute all once more, in a filter."""
    rows = found.select("doc_id", F.posexplode_outer("found").alias("at", "x")).where("x IS NOT NULL")
    return rows.select("doc_id", F.col("x.word").alias("word"), n(F.col("x.n")).alias("n"), n(F.col("at") + 1).alias("place"))


LETTERS = "[a-zA-Z" + lx.ACCENTED_FR + r"\x{0600}-\x{06FF}]"


@on(
    "documents",
    "section_keywords",
    rf"""
    WITH l AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{LETTERS}{{4,}}')), lambda w: lower(w)) AS ws
               FROM documents WHERE length(text) >= 50),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM l),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM w GROUP BY doc_id, word),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM c
          WHERE rank <= 20 AND n >= 2 AND NOT list_contains([{', '.join(q(w) for w in lx.SECTION_STOP)}], word))
    SELECT doc_id, word, n, place FROM k WHERE place <= 10
    """,
)
def section_keyword_rows(docs: DataFrame) -> DataFrame:
    return _ranked(docs.select("doc_id", entities.ranked_section_keywords(F.col("text")).alias("found")))


@on(
    "documents",
    "stopword_anti",
    rf"""
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents)
    WHERE word NOT IN ({', '.join(q(w) for w in lx.FRENCH_STOP_KEYWORDS)}) GROUP BY word
    """,
)
def stopword_anti(docs: DataFrame) -> DataFrame:
    """The words of the corpus without stop words: a word-list anti-join, the list being a broadcast dimension."""
    spark = docs.sparkSession
    stop = spark.createDataFrame([(w,) for w in lx.FRENCH_STOP_KEYWORDS], "word string")
    words = docs.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    return words.where("word IS NOT NULL").join(F.broadcast(stop), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


