"""Queries that put all of a document's features side by side: its analysis and its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.operators import documents
from foliant.plans import classes, scores  # noqa: F401  their SQL is used below
from foliant.plans.classes import LETTERS, WITH_LANGUAGE, s_matches
from foliant.plans.registry import SQL, joined, n, on, pattern, q, r6, s_long, s_r6, s_words


def s_size(listed: str) -> str:
    return f"CASE WHEN {listed} = '' THEN 0 ELSE len(string_split({listed}, '|')) END"


def s_arabic_only(patterns) -> str:
    plain = [(p.replace(r"\b", ""), 0) for p in patterns]
    return f"CASE WHEN language IN ('ar', 'mixed') THEN array_to_string(list_sort(list_distinct({s_matches(plain, False)})), '|') ELSE '' END"


ANALYSED = ("type_document", "confidence_score", "secteur", "personnes", "lieux", "organisations", "dates", "numeros_reference", "mots_cles", "entities_total")


@on(
    "documents",
    "analysis",
    f"""
    WITH t AS ({SQL['doc_type_lexicon']}), s AS ({SQL['sector']}), e AS ({SQL['entities']}),
    k AS (SELECT doc_id, string_agg(word, '|' ORDER BY rank) AS mots_cles FROM ({SQL['top_keywords']}) GROUP BY doc_id),
    p AS (SELECT doc_id, language, length(text) AS chars, {s_arabic_only(lx.PERSONS_AR)} AS personnes, {s_arabic_only(lx.ORGANISATIONS_AR)} AS organisations FROM ({WITH_LANGUAGE})),
    a AS (SELECT doc_id, language, chars, type_document, confidence AS confidence_score, secteur, personnes, places AS lieux, organisations, dates, refs AS numeros_reference,
                 coalesce(mots_cles, '') AS mots_cles, {s_long(' + '.join(s_size(x) for x in ('personnes', 'places', 'organisations', 'dates')))} AS entities_total
          FROM p JOIN t USING (doc_id) JOIN s USING (doc_id) JOIN e USING (doc_id) LEFT JOIN k USING (doc_id))
    SELECT doc_id, language, {', '.join(f"CASE WHEN language <> 'unknown' THEN {x} END AS {x}" for x in ANALYSED)},
           CASE WHEN language <> 'unknown' THEN 'success' ELSE 'error' END AS processing_status, {s_long('chars')} AS text_length FROM a
    """,
)
def analysis(docs: DataFrame) -> DataFrame:
    found = documents.analyse(docs.select("doc_id", "text")).drop("text")
    lists = ("personnes", "lieux", "organisations", "dates", "numeros_reference", "mots_cles")
    shown = {name: joined(F.col(name)) for name in lists} | {name: n(F.col(name)) for name in ("entities_total", "text_length")}
    return found.withColumns(shown | {"confidence_score": r6(F.col("confidence_score"))})


MONTHS = f"{lx.MONTHS_FR}|{lx.MONTHS_AR_PARSED}"
DATE = pattern(rf"\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{4}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}", True)
NUMBERS, NAMED = q(r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"), pattern(rf"(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})", True)


def s_month_of(word: str) -> str:
    groups = (lx.MONTHS_FR, lx.MONTHS_AR_PARSED)
    return "greatest(" + ", ".join(f"coalesce(list_position([{', '.join(q(m) for m in g.split('|'))}], {word}), 0)" for g in groups) + ")"


def s_date(year: str, month: str, day: str) -> str:
    return f"try_cast({year} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') AS DATE)"


#: The month comes first, unless it would be over 12.
DATES = f"""
    found AS (SELECT doc_id, regexp_extract_all(text, {DATE}) AS ds, string_split_regex(text, {DATE}) AS gaps FROM documents),
    one AS (SELECT doc_id, i, ds[i] AS d, lower(right(gaps[i], 50) || ' ' || left(gaps[i + 1], 50)) AS near FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM found)),
    number AS (SELECT *, regexp_extract(d, {NUMBERS}, 1) AS x, regexp_extract(d, {NUMBERS}, 2) AS y, regexp_extract(d, {NUMBERS}, 3) AS z,
                      regexp_extract(d, {NAMED}, 1) AS day, lower(regexp_extract(d, {NAMED}, 2)) AS word, regexp_extract(d, {NAMED}, 3) AS year FROM one),
    dated AS (SELECT doc_id, i, coalesce(CASE WHEN try_cast(x AS INT) > 12 THEN {s_date('z', 'y', 'x')} ELSE {s_date('z', 'x', 'y')} END,
                     {s_date('year', f"CAST({s_month_of('word')} AS VARCHAR)", 'day')}) AS date,
                     CASE WHEN regexp_matches(near, {q('|'.join(lx.APPROVAL_CONTEXT))}) THEN 'approval' WHEN regexp_matches(near, {q('|'.join(lx.EFFECTIVE_CONTEXT))}) THEN 'effective'
                          ELSE 'creation' END AS kind FROM number),
    days AS (SELECT doc_id, arg_max(date, i) FILTER (kind = 'approval' AND date IS NOT NULL) AS approval_date, arg_max(date, i) FILTER (kind = 'effective' AND date IS NOT NULL) AS effective_date,
                    arg_min(date, i) FILTER (kind = 'creation' AND date IS NOT NULL) AS text_creation_date FROM dated GROUP BY doc_id)
"""
FREQUENT = rf"""
    l AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{LETTERS}{{4,}}')), lambda w: lower(w)) AS ws FROM documents),
    w AS (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank
          FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM l) GROUP BY doc_id, word),
    often AS (SELECT doc_id, list(word ORDER BY rank) AS often FROM w WHERE rank <= 20 AND n > 2 GROUP BY doc_id),
    terms AS (SELECT doc_id, {s_matches([(p, 0) for p in lx.TRANSPORT_TERMS], False).replace('(text,', '(lower(text),')} AS terms FROM documents),
    key AS (SELECT doc_id, array_to_string(list_slice(list_concat(terms, list_filter(coalesce(often, []), lambda x: NOT list_contains(terms, x))), 1, 20), '|') AS keywords
            FROM terms LEFT JOIN often USING (doc_id))
"""
PARTS = (
    "doc_title", "doc_type_patterns", "doc_category", "department", "doc_version", "doc_status", "structure_counters", "lang_primary_secondary",
    "metadata_quality", "metadata_readability", "metadata_confidence",
)


@on(
    "documents",
    "metadata",
    f"""
    WITH {DATES}, {FREQUENT}, {', '.join(f'p_{name} AS ({SQL[name]})' for name in PARTS)},
    counted AS (SELECT doc_id, {s_long(f"len({s_words('text')})")} AS word_count, {s_long('length(text)')} AS character_count FROM documents)
    SELECT * FROM counted {' '.join(f'JOIN p_{name} USING (doc_id)' for name in PARTS)} JOIN key USING (doc_id) LEFT JOIN days USING (doc_id)
    """,
)
def metadata(docs: DataFrame) -> DataFrame:
    found = documents.metadata(docs.select("doc_id", "text")).drop("text")
    whole = ("word_count", "character_count", "section_count", "table_count", "figure_count", "reference_count")
    real = ("arabic_ratio", "french_ratio", "other_ratio", "quality_score", "readability_score", "confidence_score")
    shown = {name: n(F.col(name)) for name in whole} | {name: r6(F.col(name)) for name in real}
    return found.withColumns(shown | {name: joined(F.col(name)) for name in ("keywords", "secondary_languages")})
