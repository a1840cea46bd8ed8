"""Queries on language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import language
from foliant.functions import lexicons as lx
from foliant.functions.text import bare_words
from foliant.plans.registry import n, on, q, r6, s_bare, s_count, s_long, s_r6

AR = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
LATIN = r"A-Za-z\x{00C0}-\x{017F}"
ARABIC_BASIC = r"[\x{0600}-\x{06FF}]"


def s_len_of(t: str, keep: str) -> str:
    """How many characters of a class there are: what is left without all others."""
    return f"length(regexp_replace({t}, '[^{keep}]', '', 'g'))"


LATIN_N, ARABIC_N = s_len_of("text", LATIN), s_len_of("text", AR)
OTHER_N = rf"length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[{LATIN}{AR}]', '', 'g'))"


@on(
    "documents",
    "script_shares",
    f"""
    WITH c AS (SELECT doc_id, {LATIN_N} AS l, {ARABIC_N} AS a, {OTHER_N} AS o FROM documents)
    SELECT doc_id, {s_r6('l / nullif(l + a + o, 0)')} AS latin, {s_r6('a / nullif(l + a + o, 0)')} AS arabic,
           {s_r6('o / nullif(l + a + o, 0)')} AS other FROM c
    """,
)
def script_shares(docs: DataFrame) -> DataFrame:
    shares = language.script_shares(F.col("text"))
    return docs.select("doc_id", *[r6(c).alias(name) for name, c in shares.items()])


FR_LIST = "[" + ", ".join(q(w) for w in lx.FRENCH_COMMON) + "]"
AR_LIST = "[" + ", ".join(q(w) for w in lx.ARABIC_COMMON) + "]"
TOKENS = s_bare("lower(text)", lx.DETECTOR_PUNCTUATION)
WORD_COUNTS = f"""
    SELECT doc_id, text, len(list_filter(words, lambda w: list_contains({FR_LIST}, w))) AS f,
           len(list_filter(words, lambda w: list_contains({AR_LIST}, w))) AS a, len(words) AS n_words
    FROM (SELECT doc_id, text, {TOKENS} AS words FROM documents)
"""


@on(
    "documents",
    "lang_detect_words",
    f"SELECT doc_id, {s_r6('f / nullif(f + a, 0)')} AS french, {s_r6('a / nullif(f + a, 0)')} AS arabic FROM ({WORD_COUNTS})",
)
def lang_detect_words(docs: DataFrame) -> DataFrame:
    shares = language.word_shares(F.col("text"))
    return docs.select("doc_id", *[r6(c).alias(name) for name, c in shares.items()])


def s_alternation(words: str) -> str:
    """Occurrences of whole words, by splitting into words: the dialect's own boundary is ASCII only."""
    listed = "[" + ", ".join(q(w) for w in words.split("|")) + "]"
    return rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: list_contains({listed}, w)))"


F_PATTERNS = " + ".join(
    [s_count("text", lx.FRENCH_PATTERNS[0], True)]
    + [s_alternation(p.removeprefix(r"\b(").removesuffix(r")\b")) for p in lx.FRENCH_PATTERNS[1:]]
)
A_PATTERNS = " + ".join(
    [
        s_len_of("text", AR),
        s_len_of("text", lx.ARABIC_LETTERS),
        s_len_of("text", lx.ARABIC_HAMZA),
        s_len_of("text", r"\x{064B}-\x{065F}\x{0670}\x{0640}"),
    ]
)


@on(
    "documents",
    "lang_detect_patterns",
    f"""
    WITH c AS (SELECT doc_id, {F_PATTERNS} AS f, {A_PATTERNS} AS a FROM documents)
    SELECT doc_id, {s_r6('f / nullif(f + a, 0)')} AS french, {s_r6('a / nullif(f + a, 0)')} AS arabic FROM c
    """,
)
def lang_detect_patterns(docs: DataFrame) -> DataFrame:
    shares = language.pattern_shares(F.col("text"))
    return docs.select("doc_id", *[r6(c).alias(name) for name, c in shares.items()])


@on(
    "documents",
    "lang_detect_combined",
    f"""
    WITH c AS (SELECT doc_id, n_words, f, a, {LATIN_N} AS l, {ARABIC_N} AS ar, {OTHER_N} AS o, {F_PATTERNS} AS pf, {A_PATTERNS} AS pa FROM ({WORD_COUNTS})),
    s AS (SELECT doc_id, n_words, l / nullif(l + ar + o, 0) AS sl, ar / nullif(l + ar + o, 0) AS sa,
                 coalesce(.3 * l / nullif(l + ar + o, 0), 0) + coalesce(.5 * f / nullif(f + a, 0), 0) + coalesce(.2 * pf / nullif(pf + pa, 0), 0) AS fr,
                 coalesce(.3 * ar / nullif(l + ar + o, 0), 0) + coalesce(.5 * a / nullif(f + a, 0), 0) + coalesce(.2 * pa / nullif(pf + pa, 0), 0) AS ab FROM c),
    d AS (SELECT *, n_words < 3 AND coalesce(sa, 0) > .6 AS short_ar, n_words < 3 AND coalesce(sl, 0) > .6 AS short_fr FROM s)
    SELECT doc_id,
           CASE WHEN short_ar THEN 'arabic' WHEN short_fr THEN 'french' WHEN greatest(fr, ab) < .3 THEN 'unknown' WHEN fr >= ab THEN 'french' ELSE 'arabic' END AS language,
           {s_r6('CASE WHEN short_ar THEN sa WHEN short_fr THEN sl WHEN greatest(fr, ab) < .3 THEN 0 ELSE greatest(fr, ab) END')} AS confidence
    FROM d
    """,
)
def lang_detect_combined(docs: DataFrame) -> DataFrame:
    """The three kinds of shares are columns of their own first, so that each is computed once."""
    text = F.col("text")
    shares = {"s": language.script_shares(text), "w": language.word_shares(text), "p": language.pattern_shares(text)}
    docs = docs.withColumns({f"{k}_{name}": c for k, group in shares.items() for name, c in group.items()})
    docs = docs.withColumn("n_words", F.size(bare_words(text, lx.DETECTOR_PUNCTUATION)))
    held = {k: {name: F.col(f"{k}_{name}") for name in group} for k, group in shares.items()}
    found = language.detect(held["s"], held["w"], held["p"], F.col("n_words"), F.lit(False))
    docs = docs.withColumn("found", found)
    return docs.select("doc_id", F.col("found.language").alias("language"), r6(F.col("found.confidence")).alias("confidence"))


LATIN_FR_N = s_len_of("text", lx.LATIN_FR)
BASIC_N = s_len_of("text", r"\x{0600}-\x{06FF}")
FRAR = "CASE WHEN a + l = 0 THEN 'unknown' WHEN a / (a + l) > .6 THEN 'ar' WHEN a / (a + l) < .2 THEN 'fr' ELSE 'mixed' END"


@on("documents", "lang_frar", f"SELECT doc_id, {FRAR} AS language FROM (SELECT doc_id, {BASIC_N} AS a, {LATIN_FR_N} AS l FROM documents)")
def lang_frar(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", language.french_or_arabic(F.col("text")).alias("language"))


VISIBLE = f"""
    SELECT doc_id, text, {ARABIC_N} AS a, {s_len_of('text', lx.ACCENTED_FR)} AS c, {s_len_of('text', 'a-zA-Z')} AS l,
           length(regexp_replace(text, '\\s', '', 'g')) AS t FROM documents
"""


@on(
    "documents",
    "lang_section",
    f"""
    SELECT doc_id, CASE WHEN t = 0 THEN 'unknown' WHEN a / t > .1 AND (c + l) / t > .1 THEN 'mixed' WHEN a / t > .1 THEN 'arabic'
                        WHEN c > 0 OR (c + l) / t > .7 THEN 'french' ELSE 'unknown' END AS language,
           CASE WHEN t = 0 THEN 'unknown' WHEN a / t > .1 AND (c + l) / t > .1 THEN 'mixed' WHEN a / t > .1 THEN 'arabic'
                        WHEN c > 0 OR l / t > .7 THEN 'french' ELSE 'unknown' END AS page_language
    FROM ({VISIBLE})
    """,
)
def lang_section(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", language.section_language(text).alias("language"), language.section_language(text, True).alias("page_language"))


@on(
    "documents",
    "lang_primary_secondary",
    f"""
    WITH p AS (SELECT *, CASE WHEN t = 0 THEN 'unknown' WHEN a / t > .3 THEN 'arabic' WHEN c > 0 OR (c + l) / t > .7 THEN 'french' ELSE 'unknown' END AS p FROM ({VISIBLE}))
    SELECT doc_id, p AS primary_language,
           concat_ws('|', CASE WHEN p <> 'arabic' AND a / nullif(t, 0) > .1 THEN 'arabic' END, CASE WHEN p <> 'french' AND (c + l) / nullif(t, 0) > .1 THEN 'french' END) AS secondary_languages,
           {s_r6('a / nullif(t, 0)')} AS arabic_ratio, {s_r6('(c + l) / nullif(t, 0)')} AS french_ratio, {s_r6('1 - a / nullif(t, 0) - (c + l) / nullif(t, 0)')} AS other_ratio
    FROM p
    """,
)
def lang_primary_secondary(docs: DataFrame) -> DataFrame:
    found = language.content_languages(F.col("text"))
    return docs.select(
        "doc_id",
        found["primary_language"].alias("primary_language"),
        F.array_join(found["secondary_languages"], "|").alias("secondary_languages"),
        *[r6(found[c]).alias(c) for c in ("arabic_ratio", "french_ratio", "other_ratio")],
    )


@on(
    "documents",
    "lang_simple",
    f"""
    SELECT doc_id, CASE WHEN a > l THEN 'arabic' WHEN l > 0 THEN 'french' ELSE 'unknown' END AS language
    FROM (SELECT doc_id, {BASIC_N} AS a, {s_len_of('text', 'A-Za-z')} AS l FROM documents)
    """,
)
def lang_simple(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", language.simple_language(F.col("text")).alias("language"))


@on(
    "documents",
    "lang_confusion",
    f"""
    WITH f AS (SELECT lang, {FRAR} AS detected FROM (SELECT lang, {BASIC_N} AS a, {LATIN_FR_N} AS l FROM documents))
    SELECT lang, detected, count(*) AS n, {s_r6('count(*) / sum(count(*)) OVER ()')} AS share FROM f GROUP BY lang, detected
    """,
)
def lang_confusion(docs: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    found = docs.select("lang", language.french_or_arabic(F.col("text")).alias("detected")).groupBy("lang", "detected").count()
    # One row for each pair of languages: the total over them is a window on a handful of rows.
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    return found.select("lang", "detected", F.col("count").alias("n"), r6(share).alias("share"))


@on(
    "documents",
    "text_stats",
    f"""
    SELECT doc_id, {s_long('length(text)')} AS total_chars, {s_long(s_len_of('text', chr(92) + 'p{L}'))} AS alpha_chars,
           {s_long(f"len({s_bare('text', lx.DETECTOR_PUNCTUATION)})")} AS words,
           {s_long("len(string_split_regex(text, '[.!?؟]'))")} AS sentences, {s_long(BASIC_N)} AS arabic_chars,
           {s_long(s_len_of('text', 'A-Za-z'))} AS latin_chars, {s_long(s_len_of('text', lx.ACCENTED_LOWER))} AS accented_chars
    FROM documents
    """,
)
def text_stats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[n(c).alias(name) for name, c in language.text_stats(F.col("text")).items()])


@on(
    "documents",
    "lang_consistency",
    f"""
    SELECT doc_id, CASE WHEN {s_len_of('text', 'a-zA-Z' + lx.ACCENTED_FR)} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS french,
           {s_r6(f"coalesce({BASIC_N} / nullif(length(regexp_replace(text, chr(92) || 's', '', 'g')), 0), 0)")} AS arabic, CAST(.5 AS DOUBLE) AS mixed
    FROM documents
    """,
)
def lang_consistency(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[r6(language.consistency(F.col("text"), name)).alias(name) for name in ("french", "arabic", "mixed")])
