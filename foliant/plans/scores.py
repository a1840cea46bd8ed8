"""Queries on quality, readability and metadata scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import classify, language, quality
from foliant.functions import lexicons as lx
from foliant.functions.text import bare_words, mean, sentences, text_or_empty, words
from foliant.plans import classes  # noqa: F401  its SQL is used below
from foliant.plans.languages import s_len_of
from foliant.plans.registry import (
    SQL,
    joined,
    n,
    on,
    pattern,
    q,
    r6,
    register,
    s_avg,
    s_bare,
    s_count,
    s_long,
    s_r6,
    s_sentences,
    s_strip,
    s_words,
    table,
)

LOWER = s_bare("lower(text)", lx.QUALITY_PUNCTUATION)
TOP = "(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(ws) AS w) GROUP BY w))"


@on(
    "documents",
    "vocab_diversity",
    f"""
    SELECT doc_id, {s_r6('CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) > 100 THEN len(list_distinct(ws)) / sqrt(len(ws)) ELSE len(list_distinct(ws)) / len(ws) END')} AS vocabulary_diversity
    FROM (SELECT doc_id, {LOWER} AS ws FROM documents)
    """,
)
def vocab_diversity(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", bare_words(F.lower("text")).alias("ws"))
    return docs.select("doc_id", r6(quality.vocabulary_diversity(F.col("ws"))).alias("vocabulary_diversity"))


REPETITION = f"""
    SELECT d.doc_id, CASE WHEN len(ws) < 10 THEN 1 ELSE greatest(0, 1 - (top / len(ws) - .1)) END AS repetition_score
    FROM (SELECT doc_id, {LOWER} AS ws FROM documents) d
    LEFT JOIN (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({LOWER}) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id) t
    ON d.doc_id = t.doc_id
"""


@on("documents", "repetition", f"SELECT doc_id, {s_r6('repetition_score')} AS repetition_score FROM ({REPETITION})")
def repetition(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", bare_words(F.lower("text")).alias("ws"))
    return docs.select("doc_id", r6(quality.repetition_score(F.col("ws"))).alias("repetition_score"))


COMPLEXITY = s_avg(
    f"list_transform({s_sentences('text')}, lambda s: len({s_bare('s', lx.QUALITY_PUNCTUATION)}) + .5 * (length(s) - length(translate(s, ',:;()[]{{}}', ''))))"
)


@on("documents", "sentence_complexity", f"SELECT doc_id, {s_r6(f'least(1, {COMPLEXITY} / 30)')} AS sentence_complexity FROM documents")
def sentence_complexity(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", r6(quality.sentence_complexity(F.col("s"))).alias("sentence_complexity"))


FR_STOP = "[" + ", ".join(q(w) for w in lx.FRENCH_STOP_QUALITY) + "]"
FR_STOPS = f"len(list_filter(ws, lambda w: list_contains({FR_STOP}, w)))"
FR_ACCENTS = f"{s_len_of('text', lx.ACCENTED_LOWER)} / greatest({s_len_of('text', chr(92) + 'p{L}')}, 1)"


@on(
    "documents",
    "fr_readability",
    f"""
    SELECT doc_id, {s_r6(f'CASE WHEN len(ws) > 0 THEN {FR_STOPS} / len(ws) ELSE 0 END')} AS french_stop_word_ratio,
           {s_r6(f'CASE WHEN len(ws) > 0 THEN {FR_ACCENTS} ELSE 0 END')} AS french_accent_ratio
    FROM (SELECT doc_id, text, {LOWER} AS ws FROM documents)
    """,
)
def fr_readability(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", bare_words(F.lower("text")).alias("ws"))
    stops, accents = quality.french_ratios(F.col("text"), F.col("ws"))
    return docs.select("doc_id", r6(stops).alias("french_stop_word_ratio"), r6(accents).alias("french_accent_ratio"))


def s_band(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN .3 AND .7 THEN .1 WHEN {x} < .2 OR {x} > .8 THEN -.1 ELSE 0 END"


READABILITY = f"""
    WITH w AS (SELECT doc_id, text, {LOWER} AS ws, least(1, {COMPLEXITY} / 30) AS sc,
                      {s_len_of('text', chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}')} AS ar, {s_len_of('text', 'A-Za-z')} AS la FROM documents),
    m AS (SELECT w.doc_id, sc, repetition_score AS rep, CASE WHEN ar > la THEN 'arabic' WHEN la > 0 THEN 'french' ELSE 'unknown' END AS language,
                 CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) > 100 THEN len(list_distinct(ws)) / sqrt(len(ws)) ELSE len(list_distinct(ws)) / len(ws) END AS vd,
                 CASE WHEN len(ws) > 0 THEN {FR_STOPS} / len(ws) ELSE 0 END AS st, CASE WHEN len(ws) > 0 THEN {FR_ACCENTS} ELSE 0 END AS acc
          FROM w JOIN ({REPETITION}) r ON w.doc_id = r.doc_id)
    SELECT doc_id, language, greatest(0, least(1, .7 + {s_band('vd')} + {s_band('sc')} + (rep - .5) * .2
               + CASE WHEN language = 'french' AND st > .15 THEN .1 ELSE 0 END + CASE WHEN language = 'french' AND acc > .02 THEN .05 ELSE 0 END)) AS readability_score
    FROM m
"""


@on(
    "documents",
    "readability_score",
    f"SELECT doc_id, language, {s_r6('readability_score')} AS readability_score, round(readability_score, 6) > .6 AS readable FROM ({READABILITY})",
)
def readability_score(docs: DataFrame) -> DataFrame:
    found = quality.readability(docs.select("doc_id", "text"))
    score = r6(F.col("readability_score"))
    return found.select("doc_id", "language", score.alias("readability_score"), (score > 0.6).alias("readable"))


T = s_strip("text")
BASIC = f"""
    WITH w AS (SELECT doc_id, {T} AS t FROM documents),
    b AS (SELECT doc_id, length(t) AS chars, {s_len_of('t', chr(92) + 'p{L}')} AS alpha, {s_len_of('t', chr(92) + 'p{Nd}')} AS digits,
                 length(t) - length(regexp_replace(t, '\\s', '', 'g')) AS spaces, length(t) - length(translate(t, {q(lx.DETECTOR_PUNCTUATION)}, '')) AS puncts,
                 {s_bare('t', lx.QUALITY_PUNCTUATION)} AS ws, len({s_sentences('t')}) AS n_s FROM w),
    s AS (SELECT *, chars - alpha - digits - spaces - puncts AS special, len(ws) AS n_w, len(list_distinct(ws)) AS u, {s_avg('list_transform(ws, lambda w: length(w))')} AS awl FROM b),
    r AS (SELECT *, alpha / greatest(chars, 1) AS ar, special / greatest(chars, 1) AS sr, n_w / greatest(n_s, 1) AS asl, u / greatest(n_w, 1) AS vr FROM s),
    i AS (SELECT *, CASE WHEN chars = 0 THEN ['empty_text'] ELSE list_filter([CASE WHEN chars < 10 THEN 'text_too_short' END, CASE WHEN ar < .7 THEN 'low_alphabetic_content' END,
                 CASE WHEN sr > .2 THEN 'high_special_character_ratio' END, CASE WHEN awl < 2 THEN 'words_too_short' END, CASE WHEN awl > 15 THEN 'words_too_long' END,
                 CASE WHEN asl < 3 THEN 'sentences_too_short' END, CASE WHEN asl > 50 THEN 'sentences_too_long' END], lambda x: x IS NOT NULL) END AS issues FROM r),
    q AS (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE greatest(0, least(1, 1 - len(issues) * .15 + CASE WHEN ar < .5 THEN -.2 WHEN ar > .9 THEN .1 ELSE 0 END
                 + CASE WHEN vr > .5 THEN .1 WHEN vr < .2 THEN -.1 ELSE 0 END)) END AS score FROM i)
"""


@on(
    "documents",
    "basic_quality",
    BASIC
    + f"""
    SELECT doc_id, {s_long('chars')} AS char_count, {s_long('alpha')} AS alpha_count, {s_long('special')} AS special_count, {s_long('n_w')} AS word_count,
           {s_long('u')} AS unique_words, {s_long('n_s')} AS sentence_count, {s_r6('ar')} AS alpha_ratio, {s_r6('awl')} AS avg_word_length,
           {s_r6('vr')} AS vocabulary_ratio, array_to_string(issues, '|') AS issues, {s_r6('score')} AS score, round(score, 6) > .5 AND len(issues) < 3 AS valid
    FROM q
    """,
)
def basic_quality(docs: DataFrame) -> DataFrame:
    found = quality.basic_quality(docs.select("doc_id", "text"))
    c = F.col
    return found.select(
        "doc_id",
        *[n(c(x)).alias(x) for x in ("char_count", "alpha_count", "special_count", "word_count", "unique_words", "sentence_count")],
        *[r6(c(x)).alias(x) for x in ("alpha_ratio", "avg_word_length", "vocabulary_ratio")],
        joined(c("issues")).alias("issues"),
        r6(c("score")).alias("score"),
        ((r6(c("score")) > 0.5) & (F.size("issues") < 3)).alias("valid"),
    )


MOJIBAKE = "'\ufffd|Ã¡|Ã©|Ã\u00ad|Ã³|Ãº|â€™|â€œ|â€\u009d'"


@on(
    "documents",
    "extraction_artifacts",
    rf"""
    SELECT doc_id, regexp_matches(text, '\s{{5,}}') AS excessive_whitespace, regexp_matches(text, '(?i)page\s+\d+|©|\d+/\d+') AS header_footer_artifacts,
           regexp_matches(text, '\|\s*\||\t{{3,}}') AS table_artifacts, regexp_matches(text, '(?m)^[\s•\-\*]{{2,}}') AS formatting_artifacts,
           regexp_matches(text, {MOJIBAKE}) AS encoding_issues,
           regexp_matches(text, '[A-Z][^.!?]*[a-z][^.!?]*[.!?]') AS has_plain_sentence
    FROM documents
    """,
)
def extraction_artifacts(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    docs = docs.select("doc_id", "text", quality.artifact_issues(text).alias("found"))
    flags = ("excessive_whitespace", "header_footer_artifacts", "table_artifacts", "formatting_artifacts")
    return docs.select(
        "doc_id",
        *[F.array_contains("found", name).alias(name) for name in flags],
        quality.has_encoding_issues(text).alias("encoding_issues"),
        quality.has_plain_sentence(text).alias("has_plain_sentence"),
    )


def s_ascii(t: str) -> str:
    """The text with an ASCII letter or mark for each other character: the dialect's word boundaries are ASCII only."""
    return rf"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', '?', 'g'), '[^\x00-\x7F]', 'x', 'g')"


def s_advice(rules) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN {q(text)} END" for test, text in rules)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|')"


def s_has(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(found, {q(name)})" for name in names) + ")"


ARTIFACTS = rf"""
    SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '\s{{5,}}') THEN 'excessive_whitespace' END,
                   CASE WHEN {s_count("regexp_replace(text, '[" + chr(92) + "p{L}" + chr(92) + "p{M}" + chr(92) + "p{Nd}_]', 'x', 'g')", r"\bx{1,2}\s+x{1,2}\b")} > len({s_words('text')}) * .1 THEN 'broken_words' END,
                   CASE WHEN regexp_matches(text, '(?i)page\s+\d+|©|\d+/\d+') THEN 'header_footer_artifacts' END,
                   CASE WHEN regexp_matches(text, '\|\s*\||\t{{3,}}') THEN 'table_artifacts' END,
                   CASE WHEN regexp_matches(text, '(?m)^[\s•\-\*]{{2,}}') THEN 'formatting_artifacts' END,
                   CASE WHEN regexp_matches(text, {MOJIBAKE}) THEN 'encoding_issues' END], lambda x: x IS NOT NULL) AS artifacts,
           CASE WHEN len({s_sentences('text')}) = 0 THEN 0 ELSE greatest(0, CASE WHEN contains(text, chr(10) || chr(10)) THEN .1 ELSE 0 END
                     - CASE WHEN regexp_matches(text, '[A-Z][^.!?]*[a-z][^.!?]*[.!?]') THEN 0 ELSE .2 END) END AS structure
    FROM documents
"""
ADVICE = (
    ("o < .4", "Text quality is poor. Consider re-extracting from source or using a different extraction method."),
    (s_has("text_too_short"), "Text is too short for reliable analysis. Ensure complete extraction."),
    (s_has("encoding_issues"), "Encoding issues detected. Check source encoding and extraction settings."),
    (s_has("excessive_whitespace", "formatting_artifacts"), "Clean up formatting artifacts and excessive whitespace."),
    (s_has("broken_words"), "Text appears to have broken words. Consider OCR post-processing or manual review."),
    (s_has("low_alphabetic_content"), "Text has low alphabetic content. May contain too much formatting or special characters."),
    ("o > .7", "Text quality is good and suitable for all processing tasks."),
    ("o > .5 AND o <= .7", "Text quality is adequate for most processing tasks."),
    ("o <= .5", "Text quality is marginal. Proceed with caution for important applications."),
)
SUGGESTED = (
    (s_has("excessive_whitespace"), r"Remove excessive whitespace using regex: re.sub(r'\s+', ' ', text)"),
    (s_has("broken_words"), "Consider post-processing to rejoin broken words"),
    (s_has("encoding_issues"), "Re-extract with proper encoding (UTF-8) or use encoding detection"),
    (s_has("header_footer_artifacts"), "Remove headers/footers using pattern matching"),
)


@on(
    "documents",
    "comprehensive_quality",
    BASIC
    + f""",
    v AS (SELECT doc_id, issues, CAST(score AS DOUBLE) AS score, round(score, 6) > .5 AND len(issues) < 3 AS valid FROM q),
    e AS (SELECT v.*, CAST(readability_score AS DOUBLE) AS readable, CASE WHEN valid THEN artifacts ELSE ['failed_basic_quality'] END AS extraction,
                 CASE WHEN valid THEN greatest(0, score * (1 - len(artifacts) * .15) * structure) END AS extracted
          FROM v JOIN ({ARTIFACTS}) a USING (doc_id) JOIN ({READABILITY}) r USING (doc_id)),
    f AS (SELECT *, list_sort(list_distinct(list_concat(issues, extraction))) AS found, round(score * .4 + extracted * .3 + readable * .3, 6) AS o FROM e)
    SELECT doc_id, {s_r6('score')} AS score, {s_r6('extracted')} AS extraction_score, {s_r6('readable')} AS readability_score, {s_r6('o')} AS overall_score,
           CASE WHEN o >= .8 THEN 'excellent' WHEN o >= .6 THEN 'good' WHEN o >= .4 THEN 'fair' WHEN o IS NOT NULL THEN 'poor' END AS rating,
           o > .4 AS usable, o > .5 AS recommended_for_summarization, o > .6 AS recommended_for_chat, array_to_string(found, '|') AS all_issues,
           CASE WHEN o IS NOT NULL THEN {s_advice(ADVICE)} END AS recommendations, {s_advice(SUGGESTED)} AS suggestions,
           CASE WHEN o IS NULL THEN 'error' ELSE 'success' END AS processing_status
    FROM f
    """,
)
def comprehensive_quality(docs: DataFrame) -> DataFrame:
    found = quality.comprehensive(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[r6(F.col(x)).alias(x) for x in ("score", "extraction_score", "readability_score", "overall_score")],
        "rating",
        "usable",
        "recommended_for_summarization",
        "recommended_for_chat",
        joined(F.col("all_issues")).alias("all_issues"),
        joined(F.col("recommendations")).alias("recommendations"),
        joined(quality.suggestions(F.col("all_issues"))).alias("suggestions"),
        "processing_status",
    )


@on(
    "documents",
    "source_specific_quality",
    rf"""
    WITH t AS (SELECT doc_id, text, {s_ascii('text')} AS a, len({s_words('text')}) AS n_words, {LOWER} AS lows, len({s_bare('text', lx.QUALITY_PUNCTUATION)}) AS n_bare FROM documents),
    i AS (SELECT *, list_filter([CASE WHEN regexp_matches(text, {pattern(r"\w[A-Z][a-z]+[A-Z]")}) THEN 'column_merge_issues' END,
                        CASE WHEN regexp_matches(a, '\b[A-Z]{{3,}}\b.*\b[A-Z]{{3,}}\b') THEN 'font_size_artifacts' END,
                        CASE WHEN (length(text) - length(replace(text, 'http', ''))) / 4 > n_words * .05 THEN 'excessive_hyperlinks' END], lambda x: x IS NOT NULL) AS pdf,
                 list_filter([CASE WHEN regexp_matches(a, '\b[Il1|]{{2,}}\b') THEN 'character_confusion' END, CASE WHEN regexp_matches(a, '\brn\b') THEN 'rn_m_confusion' END,
                        CASE WHEN regexp_matches(a, '\bvv\b') THEN 'vv_w_confusion' END, CASE WHEN regexp_matches(a, '\b[O0]{{2,}}\b') THEN 'o_zero_confusion' END,
                        CASE WHEN {s_count('a', chr(92) + 'b[A-Za-z0-9_]' + chr(92) + 'b')} > n_words * .15 THEN 'excessive_single_characters' END,
                        CASE WHEN len(list_filter(lows, lambda w: length(w) > 2 AND regexp_matches(w, '[^\p{{L}}]'))) > len(lows) * .2 THEN 'suspicious_character_sequences' END],
                        lambda x: x IS NOT NULL) AS ocr,
                 {s_count('a', chr(92) + 'b[A-Za-z0-9_]' + chr(92) + 'b')} + {s_count('text', '[Il1|]{2,}')} + {s_count('text', r"[^\w\s.,!?؟،؛]")} AS odd FROM t)
    SELECT doc_id, array_to_string(pdf, '|') AS pdf_issues, array_to_string(ocr, '|') AS ocr_issues,
           {s_r6('CASE WHEN n_bare = 0 THEN 0 ELSE greatest(0, 1 - odd / n_bare) END')} AS ocr_confidence, {s_r6('greatest(0, 1 - len(pdf) * .2)')} AS pdf_specific_score FROM i
    """,
)
def source_specific_quality(docs: DataFrame) -> DataFrame:
    """Checks of texts that come from PDF files or from images."""
    text = F.col("text")
    docs = docs.select("doc_id", quality.pdf_issues(text).alias("pdf"), quality.ocr_issues(text).alias("ocr"), quality.ocr_confidence(text).alias("c"))
    score = F.greatest(F.lit(0.0), 1.0 - F.size("pdf") * 0.2)
    return docs.select(
        "doc_id",
        joined(F.col("pdf")).alias("pdf_issues"),
        joined(F.col("ocr")).alias("ocr_issues"),
        r6(F.col("c")).alias("ocr_confidence"),
        r6(score).alias("pdf_specific_score"),
    )


@on("documents", "cleaner_quality")
def cleaner_quality(docs: DataFrame) -> DataFrame:
    from foliant.functions.text import sentences_segmented, well_formed

    docs = docs.select("doc_id", "text", sentences_segmented(F.col("text")).alias("s"))
    good = F.size(F.filter("s", lambda s: well_formed(s, "french")))
    docs = docs.withColumn("well_formed_ratio", F.coalesce(F.try_divide(good, F.size("s")), F.lit(0.0)))
    found = quality.cleaner_quality(F.col("text"), F.col("well_formed_ratio"), language.consistency(F.col("text"), "french"))
    return docs.select("doc_id", "well_formed_ratio", *[c.alias(name) for name, c in found.items()])


WS = s_words("text")
META_QUALITY = rf"""
    SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE
        (least(length(text) / 10000, 1) + CASE WHEN regexp_matches(text, '(?i)chapitre|section|article|\n\n') THEN 1 ELSE .5 END
         + least(len(list_filter(string_split_regex(text, '[.!?؟۔]'), lambda s: length({s_strip('s')}) > 10)) / 10, 1)
         + CASE WHEN len(ws) > 0 THEN 1 - len(list_filter(ws, lambda w: regexp_matches(w, '[a-zA-Z]') AND regexp_matches(w, '[\x{{0600}}-\x{{06FF}}]'))) / len(ws) ELSE 0 END)
        / CASE WHEN len(ws) > 0 THEN 4 ELSE 3 END END AS quality_score
    FROM (SELECT doc_id, text, {WS} AS ws FROM documents)
"""


@on("documents", "metadata_quality", f"SELECT doc_id, {s_r6('quality_score')} AS quality_score FROM ({META_QUALITY})")
def metadata_quality(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", r6(quality.metadata_quality(text_or_empty(F.col("text")))).alias("quality_score"))


META_SENTENCES = f"len(list_filter(string_split_regex(text, '[.!?؟۔]+'), lambda s: {s_strip('s')} <> ''))"


@on(
    "documents",
    "metadata_readability",
    f"""
    SELECT doc_id, {s_r6(f'''CASE WHEN n_s = 0 OR len(ws) = 0 THEN 0 ELSE greatest(0, 1 - greatest(0, (len(ws) / n_s - 20) / 30)
           - greatest(0, ({s_avg('list_transform(ws, lambda w: length(w))')} - 6) / 4)) END''')} AS readability_score
    FROM (SELECT doc_id, {WS} AS ws, {META_SENTENCES} AS n_s FROM documents)
    """,
)
def metadata_readability(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", r6(quality.metadata_readability(F.col("text"))).alias("readability_score"))


@register(
    "quality_vs_label",
    f"""
    SELECT quality AS label, count(*) AS n, {s_r6('avg(quality_score)')} AS mean_score, {s_r6('min(quality_score)')} AS least, {s_r6('max(quality_score)')} AS most
    FROM ({META_QUALITY}) d JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality
    """,
)
def quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata score of labelled documents by their label; the score is computed after the join."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    scored = docs.select("label", quality.metadata_quality(F.col("text")).alias("s"))
    return scored.groupBy("label").agg(
        F.count("*").alias("n"), r6(F.avg("s")).alias("mean_score"), r6(F.min("s")).alias("least"), r6(F.max("s")).alias("most")
    )


@on(
    "documents",
    "metadata_confidence",
    f"""
    WITH t AS ({SQL['doc_type_patterns']}), l AS ({SQL['lang_primary_secondary']}), s AS ({SQL['structure_counters']}), h AS ({SQL['doc_title']})
    SELECT d.doc_id, {s_r6("""(CASE WHEN length(text) > 1000 THEN 1.0 WHEN length(text) > 100 THEN 0.7 ELSE 0.3 END + CASE WHEN document_type <> 'unknown' THEN 0.8 ELSE 0.3 END
           + CASE WHEN primary_language <> 'unknown' THEN 0.9 ELSE 0.4 END + CASE WHEN section_count > 0 THEN 0.9 ELSE 0.6 END + CASE WHEN title <> '' THEN 0.8 ELSE 0.5 END) / 5""")} AS confidence_score
    FROM documents d JOIN t USING (doc_id) JOIN l USING (doc_id) JOIN s USING (doc_id) JOIN h USING (doc_id)
    """,
)
def metadata_confidence(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    docs = docs.select(
        "doc_id",
        F.length(text).alias("chars"),
        classify.metadata_type(text).alias("t"),
        language.content_languages(text)["primary_language"].alias("l"),
        classify.structure_counters(text)["section_count"].alias("s"),
        classify.title(text).alias("title"),
    )
    c = F.col
    return docs.select("doc_id", r6(quality.metadata_confidence(c("chars"), c("t"), c("l"), c("s"), c("title"))).alias("confidence_score"))


@on(
    "documents",
    "word_lengths",
    f"SELECT doc_id, {s_r6(s_avg(f'list_transform({WS}, lambda w: length(w))'))} AS avg_word_length, {s_long(s_count('text', '[0-9]+'))} AS numbers FROM documents",
)
def word_lengths(docs: DataFrame) -> DataFrame:
    length = mean(F.transform(words(F.col("text")), lambda w: F.length(w).cast("double")))
    return docs.select("doc_id", r6(F.coalesce(length, F.lit(0.0))).alias("avg_word_length"), n(F.regexp_count("text", F.lit("[0-9]+"))).alias("numbers"))


