"""Queries on cleaning, filters, similarity of sentences, hashes and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions import text as tx
from foliant.operators import documents
from foliant.plans.registry import BLANKS, joined, n, on, pattern, q, r6, s_bare, s_long, s_pieces, s_r6, s_sentences, s_strip, s_words


@on("documents", "light_clean", r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS cleaned FROM documents")
def light_clean(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.clean_light(F.col("text")).alias("cleaned"))


BASIC = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\|\s*\|', ' ', 'g'), '_{3,}', '', 'g'), '-{3,}', '', 'g')"


@on("documents", "basic_clean", f"SELECT doc_id, {s_strip(BASIC)} AS cleaned FROM documents")
def basic_clean(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.clean_basic(F.col("text")).alias("cleaned"))


RSTRIPPED = f"array_to_string(list_transform(string_split(text, chr(10)), lambda s: rtrim(s, {BLANKS})), chr(10))"


@on(
    "documents",
    "final_normalize",
    rf"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({RSTRIPPED}, '^\n\n\n+', chr(10) || chr(10)),
                                                 '([^\n])\n\n\n\n+', '\1' || chr(10) || chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS cleaned
    FROM documents
    """,
)
def final_normalize(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.normalise_final(F.col("text")).alias("cleaned"))


HEADERS = pattern("|".join(f"(?:{p})" for p in lx.HEADER_FOOTER), True)


@on(
    "documents",
    "header_footer_clean",
    f"""
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {s_strip('s')}),
                                               lambda s: s = '' OR NOT regexp_matches(s, {HEADERS})), chr(10)) AS cleaned
    FROM documents
    """,
)
def header_footer_clean(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.drop_headers_footers(F.col("text")).alias("cleaned"))


@on("documents", "clean_levels")
def clean_levels(docs: DataFrame) -> DataFrame:
    """The whole chain at its three levels, for French texts."""
    held = docs.select("doc_id", "text")
    for level in ("light", "standard", "aggressive"):
        held = held.withColumn(level, tx.clean_text(F.col("text"), "french", level, normalise=False))
    return held.drop("text")


@on("documents", "clean_full")
def clean_full(docs: DataFrame) -> DataFrame:
    """The standard chain with Unicode normalisation, and what is left of it for summaries."""
    held = docs.select("doc_id", tx.clean_text(F.col("text"), "french").alias("cleaned"))
    return held.withColumn("for_summary", tx.clean_for_summary(F.col("cleaned")))


def s_subs(t: str, *steps: tuple[str, str]) -> str:
    """Replacements of patterns one after the other; groups are named as in the library's."""
    for found, put in steps:
        t = f"regexp_replace({t}, {pattern(found)}, {q(put.replace('$', chr(92)))}, 'g')"
    return t


def s_starts(t: str, patterns) -> str:
    return f"regexp_matches({t}, {pattern('|'.join('^(?:' + p.removeprefix('^') + ')' for p in patterns))})"


LINES = f"list_transform(string_split(text, chr(10)), lambda s: {s_strip('s')})"
UPPER_FR = lx.ACCENTED_FR[len(lx.ACCENTED_FR) // 2 :]
LINE = s_strip(
    s_subs(
        "s", (r"\s+([.!?;:,])", "$1"), (rf"([.!?])\s*([A-Z{UPPER_FR}؀-ۿ])", "$1 $2"), (r"[.]{3,}", "..."), ("[-]{3,}", "---"), ('["„]', '"'),
        ("['`´]", "'"), (r"\s[^\w\s]\s", " "), (r"\s+", " "),
    )
)


@on(
    "documents",
    "clean_standard",
    f"""
    WITH l AS (SELECT doc_id, list_filter({LINES}, lambda s: s = '' OR NOT {s_starts('s', lx.NOISE_LINES)}) AS ls FROM documents)
    SELECT doc_id, array_to_string(list_filter(list_transform(ls, lambda s: CASE WHEN s = '' THEN '' ELSE nullif({LINE}, '') END), lambda s: s IS NOT NULL), chr(10)) AS cleaned FROM l
    """,
)
def clean_standard(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.clean_standard(F.col("text")).alias("cleaned"))


MARKS = f"(length(s) - length(translate(s, {q(lx.PUNCTUATION)}, '')))"


@on(
    "documents",
    "line_filters",
    f"""
    WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents)
    SELECT doc_id, {s_long('len(ls)')} AS n_lines, {s_long(f"len(list_filter(ls, lambda s: {s_starts('s', lx.NOISE_LINES)}))")} AS n_noise,
           {s_long(f"len(list_filter(ls, lambda s: length(s) >= 5 AND {MARKS} <= length(s) * .5 AND NOT {s_starts('s', lx.NOISE_LINES)}))")} AS n_surviving FROM l
    """,
)
def line_filters(docs: DataFrame) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), tx.strip)
    docs = docs.select("doc_id", lines.alias("ls"))
    noise, kept = F.filter("ls", tx.is_noise), F.filter("ls", tx.survives)
    return docs.select("doc_id", n(F.size("ls")).alias("n_lines"), n(F.size(noise)).alias("n_noise"), n(F.size(kept)).alias("n_surviving"))


def s_fixed(t: str) -> str:
    for broken, right in lx.MOJIBAKE:
        t = f"replace({t}, {q(broken)}, {q(right)})"
    return t


BROKEN = {"e": "Ã©", "a ": "Ã ", "o": "Ã´", "'": "â€™"}


@on(
    "documents",
    "fix_encoding",
    f"""
    WITH b AS (SELECT doc_id, {'replace(' * len(BROKEN)}text{''.join(f", {q(a)}, {q(b)})" for a, b in BROKEN.items())} AS t FROM documents)
    SELECT doc_id, {s_fixed('t')} AS fixed FROM b
    """,
)
def fix_encoding(docs: DataFrame) -> DataFrame:
    """Texts with some letters broken as a wrong decoding does, put right."""
    text = F.col("text")
    for good, broken in BROKEN.items():
        text = F.replace(text, F.lit(good), F.lit(broken))
    return docs.select("doc_id", tx.fix_encoding(text).alias("fixed"))


#: Latin letters and marks, and the Arabic ones that stand for them in texts made for the Arabic steps.
FROM_LATIN, TO_ARABIC = "aeiounlrstdmph,;?", "اإأآىوئلرستدهـ،؛؟"
ARABISED = f"translate(replace(lower(text), 'the', 'ال'), {q(FROM_LATIN)}, {q(TO_ARABIC)})"


def arabised(text):
    return F.translate(F.replace(F.lower(text), F.lit("the"), F.lit("ال")), FROM_LATIN, TO_ARABIC)


@on("documents", "fold_arabic", f"SELECT doc_id, translate({ARABISED}, 'إأآىئه،؛؟ـ', 'ااايية,;?') AS folded FROM documents")
def fold_arabic(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.fold_arabic(arabised(F.col("text"))).alias("folded"))


@on(
    "documents",
    "clean_arabic",
    rf"""
    WITH t AS (SELECT doc_id, {s_subs(ARABISED, (r"\s*([،؛؟])", "$1"), (r"([،؛؟])\s*", "$1 "))} AS t FROM documents),
    p AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '[\x{{0600}}-\x{{06FF}}]')) / greatest(length(t), 1) > .3 THEN translate(t, '()', ')(') ELSE t END AS t FROM t)
    SELECT doc_id, {s_subs("t", (r"(\w)\s+(ال)", "$1$2"), (r"(و)\s+(\w)", "$1$2"), (r"[\x{064B}-\x{0652}]", ""))} AS cleaned FROM p
    """,
)
def clean_arabic(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.clean_arabic(arabised(F.col("text")), drop_diacritics=True).alias("cleaned"))


FRENCH = s_subs(
    "text", (r"(\w)\s*['`´]\s*(\w)", "$1'$2"), (r"<<\s*", "« "), (r"\s*>>", " »"), (r"\s*([;:!?])", " $1"), (r"([;:!?])\s*", "$1 "),
    (r"(^|[^\w])([A-Z])\.\s*([A-Z])\.\s*([A-Z])", "$1$2.$3.$4"), *[(rf"(?i)(^|[^\w]){e}'\s*", f"$1{e}'") for e in lx.ELISIONS],
)


@on("documents", "clean_french", f"SELECT doc_id, {FRENCH} AS cleaned FROM documents")
def clean_french(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.clean_french(F.col("text")).alias("cleaned"))


OCR_DROPPED = r"[^\w\s؀-ۿÀ-ÿ.,;:!?()\-'\"]+"
WORDLIKE = r"[\p{L}\p{M}\p{N}_]"


def s_run(i: str) -> str:
    """Whether the character at ``i`` repeats the one before within a run of four or more."""
    before = [f"c[{i} - {k}] = c[{i}]" for k in (1, 2, 3)]
    after = [f"c[{i} + {k}] = c[{i}]" for k in (1, 2)]
    spans = [" AND ".join(f"coalesce({x}, false)" for x in before[: 3 - k] + after[:k]) for k in range(3)]
    return "((" + ") OR (".join(spans) + "))"


@on(
    "documents",
    "ocr_clean",
    rf"""
    WITH n AS (SELECT doc_id, {s_strip(rf"regexp_replace(regexp_replace(text, {pattern(OCR_DROPPED)}, ' ', 'g'), '\s+', ' ', 'g')")} AS t FROM documents),
    k AS (SELECT doc_id, string_split(array_to_string(list_filter(string_split(t, chr(10)), lambda s: length({s_strip('s')}) > 2), ' '), '') AS c FROM n),
    w AS (SELECT doc_id, c, list_transform(c, lambda x: regexp_matches(x, '{WORDLIKE}')) AS b FROM k),
    s AS (SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN b[i] AND NOT coalesce(i > 1 AND b[i - 1], false) AND NOT coalesce(b[i + 1], false) THEN ' ' ELSE x END) AS c FROM w),
    r AS (SELECT doc_id, array_to_string(list_filter(c, lambda x, i: NOT (i > 1 AND {s_run('i')})), '') AS processed_text FROM s)
    SELECT doc_id, processed_text, {s_long(f"len(list_filter({s_pieces('processed_text', '[.!?]+')}, lambda s: length(s) > 5))")} AS sentence_count FROM r
    """,
)
def ocr_clean(docs: DataFrame) -> DataFrame:
    cleaned = tx.drop_ocr_noise(tx.normalise_ocr(F.col("text"), "french"))
    held = docs.select("doc_id", cleaned.alias("processed_text"))
    return held.withColumn("sentence_count", n(F.size(tx.sentences_ocr(F.col("processed_text")))))


@on(
    "documents",
    "sentence_filters",
    f"""
    SELECT doc_id, {s_long(f"len(list_filter({s_sentences('text')}, lambda s: len({s_words('s')}) > 3))")} AS over_three_words,
           {s_long(f"len(list_filter({s_sentences('text')}, lambda s: len({s_words('s')}) >= 5))")} AS five_words,
           {s_long(f"len(list_filter({s_sentences('text')}, lambda s: length(s) BETWEEN 10 AND 500))")} AS of_length,
           {s_long(f"len(list_filter({s_sentences('text')}, lambda s: length(s) > 20))")} AS over_twenty,
           {s_long(f"len(list_filter({s_pieces('text', '[.!?]+')}, lambda s: length(s) > 5))")} AS ocr_sentences
    FROM documents
    """,
)
def sentence_filters(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", tx.sentences(F.col("text")).alias("s"))
    size = lambda test: n(F.size(F.filter("s", test)))
    return docs.select(
        "doc_id",
        size(lambda s: F.size(tx.words(s)) > 3).alias("over_three_words"),
        size(lambda s: F.size(tx.words(s)) >= 5).alias("five_words"),
        size(lambda s: F.length(s).between(10, 500)).alias("of_length"),
        size(lambda s: F.length(s) > 20).alias("over_twenty"),
        n(F.size(tx.sentences_ocr(F.col("text")))).alias("ocr_sentences"),
    )


@on(
    "documents",
    "well_formed",
    f"""
    WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE len({s_words('s')}) >= 3 AND regexp_matches(s, '[.!?؟]')
                   AND len(list_distinct(list_filter(string_split(lower(s), ''), lambda c: c <> ''))) >= length(s) * .3
                   AND length(regexp_replace(s, '[^a-zA-Z{lx.ACCENTED_FR}]', '', 'g')) >= length(s) * .5) AS well_formed, count(*) AS lines
    FROM s GROUP BY doc_id
    """,
)
def well_formed(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    good = F.size(F.filter("lines", lambda s: tx.well_formed(s, "french")))
    return docs.select("doc_id", n(good).alias("well_formed"), n(F.size("lines")).alias("lines"))


@on(
    "documents",
    "adjacent_sentence_jaccard",
    f"""
    WITH w AS (SELECT doc_id, list_transform({s_sentences('text')}, lambda s: list_distinct({s_words('lower(s)')})) AS ws FROM documents),
    p AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w))
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS place,
           {s_r6('CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END')} AS jaccard,
           {s_r6('CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END')} AS coverage
    FROM p
    """,
)
def adjacent_sentence_jaccard(docs: DataFrame) -> DataFrame:
    """Each sentence against the next one of its document."""
    sets = F.transform(tx.sentences(F.col("text")), tx.word_set)
    docs = docs.select("doc_id", sets.alias("ws"))
    last = F.size("ws") - 1
    pairs = F.zip_with(
        F.slice("ws", F.lit(1), F.greatest(F.lit(0), last)),
        F.slice("ws", F.lit(2), F.greatest(F.lit(0), last)),
        lambda a, b: F.struct(tx.jaccard(a, b).alias("jaccard"), tx.coverage(a, b).alias("coverage")),
    )
    rows = docs.select("doc_id", F.posexplode_outer(pairs).alias("place", "p")).where("p IS NOT NULL")
    return rows.select("doc_id", n(F.col("place")).alias("place"), r6(F.col("p.jaccard")).alias("jaccard"), r6(F.col("p.coverage")).alias("coverage"))


#: Pairs first; then, in order, a sentence goes if one that it is close to is there still.
@on(
    "documents",
    "greedy_dedup",
    f"""
    WITH RECURSIVE l AS (SELECT doc_id, {s_sentences('text')} AS ss FROM documents),
    s AS (SELECT doc_id, s, j, list_distinct({s_words('lower(s)')}) AS w FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM l)),
    near AS (SELECT b.doc_id, b.j, list(a.j) AS earlier, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.j) AS step FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.j < b.j
             WHERE least(len(a.w), len(b.w)) >= .8 * greatest(len(a.w), len(b.w))
               AND len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) > .8 GROUP BY b.doc_id, b.j),
    walk AS (SELECT DISTINCT doc_id, 0 AS step, CAST([] AS BIGINT[]) AS gone FROM near
             UNION ALL
             SELECT near.doc_id, near.step, CASE WHEN len(list_filter(earlier, lambda i: NOT list_contains(gone, i))) > 0 THEN list_append(gone, j) ELSE gone END
             FROM walk JOIN near ON walk.doc_id = near.doc_id AND near.step = walk.step + 1),
    last AS (SELECT doc_id, arg_max(gone, step) AS gone FROM walk GROUP BY doc_id),
    kept AS (SELECT l.doc_id, ss, CASE WHEN gone IS NULL THEN ss ELSE list_filter(ss, lambda x, i: NOT list_contains(gone, i)) END AS k FROM l LEFT JOIN last ON l.doc_id = last.doc_id)
    SELECT doc_id, {s_long('len(ss)')} AS n_sentences, {s_long('len(k)')} AS n_kept, array_to_string(k, '. ') AS text FROM kept
    """,
)
def greedy_dedup(docs: DataFrame) -> DataFrame:
    """Documents without sentences that are nearly the same as an earlier one of theirs."""
    docs = docs.select("doc_id", tx.sentences(F.col("text")).alias("s"))
    docs = docs.withColumn("kept", tx.drop_redundant(F.col("s"), 0.8))
    return docs.select("doc_id", n(F.size("s")).alias("n_sentences"), n(F.size("kept")).alias("n_kept"), F.array_join("kept", ". ").alias("text"))


@on(
    "documents",
    "content_hash_dedup",
    "SELECT md5(text) AS content_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1",
)
def content_hash_dedup(docs: DataFrame) -> DataFrame:
    return documents.content_duplicates(docs)


@on("documents", "content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(docs: DataFrame) -> DataFrame:
    held = F.col("text").cast("binary")
    return docs.select("doc_id", F.md5(held).alias("md5"), F.sha2(held, 256).alias("sha256"))


SIZE = "strlen(html)"
POWER = f"(CAST({SIZE} >= 1024 AS INT) + CAST({SIZE} >= 1048576 AS INT))"


@on(
    "pages",
    "human_size",
    rf"""
    SELECT page_id, {s_long(SIZE)} AS size,
           CASE WHEN {SIZE} = 0 THEN '0 B' ELSE regexp_replace(format('{{:.2f}}', round_even({SIZE} / power(1024.0, {POWER}), 2)), '0$', '') || ' ' || ['B', 'KB', 'MB'][{POWER} + 1] END AS size_human
    FROM pages
    """,
)
def human_size(pages: DataFrame) -> DataFrame:
    size = F.octet_length("html")
    return pages.select("page_id", n(size).alias("size"), documents.human_size(size).alias("size_human"))


PLAIN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


@on(
    "pages",
    "page_text_stats",
    f"""
    SELECT page_id, {s_long(f'length({PLAIN})')} AS chars, {s_long(f"len({s_words(PLAIN)})")} AS words, {s_long(f"len({s_sentences(PLAIN)})")} AS sentences
    FROM pages
    """,
)
def page_text_stats(pages: DataFrame) -> DataFrame:
    """Text statistics of pages without their tags."""
    plain = pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    t = F.col("t")
    return plain.select("page_id", n(F.length(t)).alias("chars"), n(F.size(tx.words(t))).alias("words"), n(F.size(tx.sentences(t))).alias("sentences"))


@on(
    "documents",
    "fixed_chunks",
    f"""
    WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 800.0)) AS BIGINT) + 1)) AS i FROM documents)
    SELECT doc_id, i AS chunk_id, substr(text, i * 800 + 1, 1000) AS chunk FROM c
    """,
)
def fixed_chunks(docs: DataFrame) -> DataFrame:
    from foliant.operators.search import chunk_windows

    found = chunk_windows(docs.select("doc_id", "text"))
    return found.withColumn("chunk_id", n(F.col("chunk_id")))


@on("documents", "recursive_chunks")
def recursive_chunks(docs: DataFrame) -> DataFrame:
    from foliant.operators.search import chunk_documents

    return chunk_documents(docs.select("doc_id", "text"))


@on(
    "documents",
    "bare_words",
    f"""SELECT doc_id, array_to_string(list_slice({s_bare('lower(text)', lx.QUALITY_PUNCTUATION)}, 1, 25), '|') AS words FROM documents""",
)
def bare_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", joined(F.slice(tx.bare_words(F.lower("text")), 1, 25)).alias("words"))
