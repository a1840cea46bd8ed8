"""Queries on sections, hierarchy, reading order and reports of a document's structure.

Their SQL takes lines as rows where the library keeps them as arrays, so the two share no step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.operators import sections
from foliant.plans.classes import LETTERS
from foliant.plans.languages import ARABIC_N, s_len_of
from foliant.plans.registry import joined, n, on, pattern, q, r6, s_long, s_r6, s_strip, s_words

DOTS = "length(s) - length(replace(s, '.', ''))"
LEVEL = rf"""
    CASE WHEN s = '' THEN NULL
         WHEN regexp_matches(s, {pattern(lx.NUMBERED_HEADING, True)}) THEN least({DOTS} + 1, 6)
         WHEN regexp_matches(s, {pattern(lx.HEADINGS['universal'][1], True)}) THEN 1
         WHEN upper(s) = s AND regexp_matches(s, '\p{{Lu}}') AND length(s) BETWEEN 10 AND 100 AND NOT suffix(s, '.') AND len({s_words('s')}) <= 10 THEN 2 END
"""
PLACED = "PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def s_type(title: str, content: str) -> str:
    special = {"toc": lx.TOC_PATTERNS, "bibliography": lx.BIBLIOGRAPHY_PATTERNS, "appendix": lx.APPENDIX_PATTERNS}
    cases = []
    for name, patterns in special.items():
        either = pattern("|".join(patterns), True)
        cases.append(f"WHEN regexp_matches(lower({title}), {either}) OR regexp_matches(left(lower({content}), 200), {either}) THEN {q(name)}")
    for name, words in {"introduction": "introduction|مقدمة", "conclusion": "conclusion|خاتمة"}.items():
        cases.append(f"WHEN regexp_matches(lower({title}), {q(words)}) THEN {q(name)}")
    for name, words in {"chapter": r"chapitre\s+\d+|فصل\s+\d+", "section": r"section\s+\d+|قسم\s+\d+", "article": r"article\s+\d+|مادة\s+\d+"}.items():
        cases.append(f"WHEN regexp_matches(lower({title}), {q(words)}) THEN {q(name)}")
    return f"CASE {' '.join(cases)} WHEN len({s_words(content)}) > 500 THEN 'main_content' ELSE 'content' END"


#: Of the sections before one of level L those of level L - 2 or less: the last one is the parent, if its level is L - 2.
CUT = f"""
    lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {s_strip('x')} = '' THEN '' ELSE x END) AS ls
              FROM documents WHERE length({s_strip('text')}) >= {sections.MIN_TEXT}),
    line AS (SELECT doc_id, i, {s_strip('raw')} AS s FROM (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS i FROM lines)),
    bound AS (SELECT doc_id, i AS upto, s, level FROM (SELECT *, {LEVEL} AS level FROM line) WHERE level IS NOT NULL
              UNION ALL SELECT doc_id, len(ls), NULL, NULL FROM lines),
    span AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY upto), -1) + 1 AS start FROM bound),
    part AS (SELECT doc_id, upto AS bound, 0 AS later, CASE WHEN upto = len(ls) THEN 'Final Section' END AS title,
                    {s_strip('array_to_string(list_slice(ls, start + 1, upto), chr(10))')} AS content, 1 AS level, start, upto
             FROM span JOIN lines USING (doc_id) WHERE upto > start
             UNION ALL SELECT doc_id, upto, 1, s, s, level, upto, upto + 1 FROM span WHERE level IS NOT NULL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bound, later) - 1 AS ordinal
                 FROM part WHERE later = 1 OR length(content) >= {sections.MIN_SECTION}),
    above AS (SELECT *, {', '.join(f'max(CASE WHEN level <= {k} THEN ordinal END) OVER ({PLACED}) AS last{k}' for k in range(1, 5))} FROM numbered),
    linked AS (SELECT a.doc_id, a.ordinal, p.ordinal AS up FROM above a JOIN numbered p ON a.doc_id = p.doc_id AND p.level = a.level - 2
               AND p.ordinal = CASE a.level WHEN 3 THEN last1 WHEN 4 THEN last2 WHEN 5 THEN last3 WHEN 6 THEN last4 END),
    placed AS (SELECT s.doc_id, s.ordinal, 'section_' || s.ordinal AS id, coalesce(s.title, 'Section ' || s.ordinal) AS title, s.content, s.level,
                      s.start, s.upto, a.up, 1 + (a.up IS NOT NULL)::INT + (b.up IS NOT NULL)::INT AS depth
               FROM numbered s LEFT JOIN linked a ON s.doc_id = a.doc_id AND s.ordinal = a.ordinal LEFT JOIN linked b ON a.doc_id = b.doc_id AND a.up = b.ordinal),
    letters AS (SELECT *, {ARABIC_N} AS a, {s_len_of('text', lx.ACCENTED_FR)} AS c, {s_len_of('text', 'a-zA-Z')} AS l, length(regexp_replace(text, '\\s', '', 'g')) AS t
                FROM (SELECT *, content AS text FROM placed)),
    typed AS (SELECT doc_id, ordinal, id, title, content, level, start, upto, up, depth, {s_type('title', 'content')} AS section_type,
                     CASE WHEN t = 0 THEN 'unknown' WHEN a / t > .1 AND (c + l) / t > .1 THEN 'mixed' WHEN a / t > .1 THEN 'arabic'
                          WHEN c > 0 OR (c + l) / t > .7 THEN 'french' ELSE 'unknown' END AS language FROM letters)
"""

#: The best sentences stay as long as none before them, nor they themselves, would have exceeded the limit.
DETAILS = rf"""
    spoken AS (SELECT doc_id, ordinal, list_transform(list_filter(regexp_extract_all(content, '[\p{{L}}\p{{M}}\p{{N}}_]+'),
                      lambda w: regexp_full_match(w, '{LETTERS}{{4,}}')), lambda w: lower(w)) AS ws FROM typed WHERE length(content) >= 50),
    counted AS (SELECT doc_id, ordinal, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY count(*) DESC, min(pos)) AS rank
                FROM (SELECT doc_id, ordinal, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM spoken) GROUP BY doc_id, ordinal, word),
    key AS (SELECT doc_id, ordinal, string_agg(word, ', ' ORDER BY rank) AS keywords
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY rank) AS place FROM counted
                  WHERE rank <= 20 AND n >= 2 AND NOT list_contains([{', '.join(q(w) for w in lx.SECTION_STOP)}], word)) WHERE place <= 10 GROUP BY doc_id, ordinal),
    said AS (SELECT doc_id, ordinal, list_transform(list_filter(string_split_regex(content, '[.!?؟۔]+'), lambda x: {s_strip('x')} <> '' AND length(x) > 20), lambda x: {s_strip('x')}) AS f
             FROM typed WHERE length(content) > 500),
    scored AS (SELECT *, CAST(0.7 AS DOUBLE) / pos + least(length(s) / 100, 1) * CAST(0.3 AS DOUBLE) AS score
               FROM (SELECT doc_id, ordinal, unnest(f) AS s, generate_subscripts(f, 1) AS pos FROM said)),
    filled AS (SELECT *, coalesce(sum(length(s) + 2) OVER (PARTITION BY doc_id, ordinal ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(s) > 200 AS full
               FROM scored),
    chosen AS (SELECT doc_id, ordinal, {s_strip("coalesce(string_agg(s || '. ', '' ORDER BY score DESC, pos) FILTER (NOT over), '')")} AS summary
               FROM (SELECT *, bool_or("full") OVER (PARTITION BY doc_id, ordinal ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS over FROM filled) GROUP BY doc_id, ordinal),
    detailed AS (SELECT t.*, coalesce(keywords, '') AS keywords, CASE WHEN length(content) <= 500 THEN '' WHEN len(f) = 0 THEN left(content, 200) ELSE summary END AS summary
                 FROM typed t LEFT JOIN key USING (doc_id, ordinal) LEFT JOIN said USING (doc_id, ordinal) LEFT JOIN chosen USING (doc_id, ordinal))
"""

TOC = "(" + ", ".join(q(name) for name in sections.TOC_TYPES) + ")"
#: Sections leave the queue in order; those that then wait for nothing join it.
ORDER = """
    edge AS (SELECT doc_id, a, b, min(k) AS k FROM (
                 SELECT doc_id, up AS a, ordinal AS b, 0 AS k FROM linked
                 UNION ALL SELECT x.doc_id, x.ordinal, y.ordinal, 1 FROM numbered x JOIN numbered y ON x.doc_id = y.doc_id AND y.ordinal = x.ordinal + 1 AND abs(x.level - y.level) <= 1)
             GROUP BY doc_id, a, b),
    outward AS (SELECT doc_id, a, list(b ORDER BY k, b) AS nexts FROM edge GROUP BY doc_id, a),
    inward AS (SELECT doc_id, b, count(*) AS c FROM edge GROUP BY doc_id, b),
    graph AS (SELECT s.doc_id, list(coalesce(nexts, []) ORDER BY ordinal) AS after, list(coalesce(c, 0) ORDER BY ordinal) AS waits
              FROM numbered s LEFT JOIN outward o ON s.doc_id = o.doc_id AND s.ordinal = a LEFT JOIN inward i ON s.doc_id = i.doc_id AND s.ordinal = b GROUP BY s.doc_id),
    walk AS (SELECT doc_id, 0 AS step, list_filter(range(len(waits)), lambda i: waits[i + 1] = 0) AS queue, waits FROM graph
             UNION ALL
             SELECT doc_id, step + 1, list_concat(list_slice(queue, 2, len(queue)), list_filter(after[queue[1] + 1], lambda b: w[b + 1] = 1)),
                    list_transform(w, lambda x, i: x - list_contains(after[queue[1] + 1], i - 1)::INT)
             FROM (SELECT walk.doc_id, step, queue, walk.waits AS w, after FROM walk JOIN graph ON walk.doc_id = graph.doc_id WHERE len(queue) > 0)),
    reading AS (SELECT doc_id, string_agg('section_' || queue[1], '|' ORDER BY step) AS reading_order FROM walk WHERE len(queue) > 0 GROUP BY doc_id)
"""
QUALITY = f"""
    totals AS (SELECT doc_id, count(*) AS n, max(depth) AS depth, count(*) FILTER (section_type IN {TOC}) AS headings,
                      count(*) FILTER (section_type IN ('introduction', 'conclusion', 'toc')) AS special, avg(level) AS mean, stddev_pop(level) AS spread,
                      avg(length(content)) FILTER (section_type = 'content') AS chars, var_pop(length(content)) FILTER (section_type = 'content') AS var_chars,
                      bool_or(section_type = 'article') AS articles, bool_or(section_type = 'chapter') AS chapters, bool_or(section_type = 'toc') AS tocs,
                      bool_or(section_type = 'bibliography') AS books,
                      {', '.join(f"nullif(count(*) FILTER (language = '{x}'), 0) / count(*) AS share_{x}" for x in ('french', 'arabic', 'mixed', 'unknown'))}
               FROM typed GROUP BY doc_id),
    base AS (SELECT *, least(headings / n * 2, 1) + greatest(0, 1 - spread / mean) + least(special * .2, .4) AS base FROM totals),
    judged AS (SELECT doc_id, coalesce(n, 0) AS total_sections, coalesce(depth, 0) AS max_depth,
                      CASE WHEN n IS NULL THEN 'unknown' WHEN articles AND n > 10 THEN 'regulation' WHEN chapters OR (tocs AND n > 15) THEN 'book'
                           WHEN books THEN 'report' WHEN n < 5 THEN 'memo' ELSE 'document' END AS document_type,
                      CASE WHEN n IS NULL THEN 0 WHEN chars IS NULL THEN base / 3 ELSE (base + greatest(0, 1 - var_chars / (chars * chars))) / 4 END AS structure_quality,
                      share_french, share_arabic, share_mixed, share_unknown
               FROM documents LEFT JOIN base USING (doc_id))
"""


@on(
    "documents",
    "sections",
    f"""
    WITH {CUT}, {DETAILS}
    SELECT doc_id, {s_long('ordinal')} AS ordinal, id, title, content, {s_long('level')} AS level, {s_long('start')} AS start_position, {s_long('upto')} AS end_position,
           'section_' || up AS parent_id, {s_long('depth')} AS depth, section_type, language, keywords, summary FROM detailed
    """,
)
def section_rows(docs: DataFrame) -> DataFrame:
    found = sections.section_rows(docs.select("doc_id", "text"))
    whole = {name: n(F.col(name)) for name in ("ordinal", "level", "start_position", "end_position", "depth")}
    return found.withColumns(whole).withColumn("keywords", F.array_join("keywords", ", "))


@on(
    "documents",
    "document_structure",
    f"""
    WITH RECURSIVE {CUT}, {QUALITY}, {ORDER}
    SELECT doc_id, document_type, {s_long('max_depth')} AS max_depth, {s_long('total_sections')} AS total_sections, {s_r6('structure_quality')} AS structure_quality,
           {', '.join(f"{s_r6(f'share_{x}')} AS share_{x}" for x in ('french', 'arabic', 'mixed', 'unknown'))}, coalesce(reading_order, '') AS reading_order
    FROM judged LEFT JOIN reading USING (doc_id)
    """,
)
def document_structure(docs: DataFrame) -> DataFrame:
    found = sections.document_structure(docs.select("doc_id", "text"))
    shares = [r6(F.try_element_at("language_distribution", F.lit(x))).alias(f"share_{x}") for x in ("french", "arabic", "mixed", "unknown")]
    return found.select(
        "doc_id",
        "document_type",
        n(F.col("max_depth")).alias("max_depth"),
        n(F.col("total_sections")).alias("total_sections"),
        r6(F.col("structure_quality")).alias("structure_quality"),
        *shares,
        joined(F.col("reading_order")).alias("reading_order"),
    )


@on(
    "documents",
    "table_of_contents",
    f"""
    WITH {CUT}
    SELECT doc_id, id, 'section_' || up AS parent_id, title, {s_long('level')} AS level, {s_long('start // 50 + 1')} AS page, {s_long('ordinal')} AS ordinal
    FROM typed WHERE section_type IN {TOC}
    """,
)
def table_of_contents(docs: DataFrame) -> DataFrame:
    found = sections.table_of_contents(sections.section_rows(docs.select("doc_id", "text")))
    return found.withColumns({name: n(F.col(name)) for name in ("level", "page", "ordinal")})


@on(
    "documents",
    "structure_markdown",
    f"""
    WITH {CUT}, {DETAILS}, {QUALITY},
    bodies AS (SELECT doc_id, string_agg('### ' || title || ' {{#section-' || id || '}}' || chr(10) || '- **Type**: ' || section_type || chr(10) || '- **Level**: ' || level || chr(10)
                                         || '- **Language**: ' || language || chr(10) || CASE WHEN keywords <> '' THEN '- **Keywords**: ' || keywords || chr(10) ELSE '' END
                                         || CASE WHEN summary <> '' THEN '- **Summary**: ' || summary || chr(10) ELSE '' END, chr(10) ORDER BY ordinal) AS body,
                      string_agg(repeat('  ', depth - 1) || '- [' || title || '](#section-' || id || ')', chr(10) ORDER BY ordinal) FILTER (section_type IN {TOC}) AS toc
               FROM detailed GROUP BY doc_id)
    SELECT doc_id, '# Document Structure Analysis' || chr(10) || '- **Document Type**: ' || document_type || chr(10) || '- **Total Sections**: ' || total_sections || chr(10)
           || '- **Max Depth**: ' || max_depth || chr(10) || '- **Structure Quality**: ' || printf('%.2f', CAST(structure_quality AS DOUBLE)) || chr(10)
           || CASE WHEN toc IS NULL THEN '' ELSE chr(10) || '## Table of Contents' || chr(10) || toc || chr(10) END
           || CASE WHEN body IS NULL THEN '' ELSE chr(10) || '## Sections' || chr(10) || body END AS markdown
    FROM judged LEFT JOIN bodies USING (doc_id)
    """,
)
def structure_markdown(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return sections.to_markdown(sections.document_structure(docs), sections.section_rows(docs))
