"""Classification by lexicon scores, and the rule-ordered classes of blocks, paragraphs and sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions.text import count, count_literal, once, rx, starts, strip, words


def first_best(scores: dict[str, Column]) -> Column:
    """Struct (score, class): the first class with the largest score."""
    ranked = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("class")) for i, (n, s) in enumerate(scores.items())]
    return F.array_max(F.array(*ranked))


def with_scores(scores: dict[str, Column], use) -> Column:
    """``use(score, class, total)`` of the first class with the largest score; each score is computed once."""
    names = F.array(*map(F.lit, scores))

    def ranked(held: Column) -> Column:
        best = F.array_max(F.transform(held, lambda s, i: F.struct(s.alias("score"), (-i).alias("order"))))
        total = F.aggregate(held, F.lit(0), lambda a, s: a + s)
        return once(best, lambda b: use(b["score"], F.get(names, -b["order"]), total))

    return once(F.array(*scores.values()), ranked)


def keyword_scores(text: Column, lexicon: dict[str, list[str]], weight: int = 1, fold: bool = True) -> dict[str, Column]:
    """For each class the occurrences of its keywords; ``fold``: in lower case, which ``text`` must be in then."""
    return {
        name: sum((count_literal(text, k.lower() if fold else k) for k in terms), F.lit(0)) * weight
        for name, terms in lexicon.items()
    }


def pattern_scores(text: Column, lexicon: dict[str, list[str]], weight: int = 1) -> dict[str, Column]:
    return {name: sum((count(text, p, True) for p in terms), F.lit(0)) * weight for name, terms in lexicon.items()}


def _sum(*parts: dict[str, Column]) -> dict[str, Column]:
    return {name: sum((p[name] for p in parts[1:]), parts[0][name]) for name in parts[0]}


def document_type(text: Column, language: Column) -> Column:
    """Struct of the type and its share of all scores, in percent; by keywords and patterns of the language.

    Keywords of Arabic and mixed texts are matched as they are written.
    """
    french = lambda lower: _sum(keyword_scores(lower, lx.TYPE_KEYWORDS_FR, 2), pattern_scores(text, lx.TYPE_PATTERNS_FR, 3))
    arabic = _sum(keyword_scores(text, lx.TYPE_KEYWORDS_AR, 2, False), pattern_scores(text, lx.TYPE_PATTERNS_AR, 3))
    mixed = _sum(
        keyword_scores(text, lx.TYPE_KEYWORDS_FR, 2, False), pattern_scores(text, lx.TYPE_PATTERNS_FR, 3), arabic
    )

    def named(score: Column, name: Column, total: Column) -> Column:
        share = F.coalesce(F.try_divide(score * 100.0, total), F.lit(0.0))
        return F.struct(name.alias("type"), F.least(share, F.lit(100.0)).alias("confidence"))

    answer = lambda scores: with_scores(scores, named)
    return F.when(language == "ar", answer(arabic)).when(language == "mixed", answer(mixed)).otherwise(
        once(F.lower(text), lambda lower: answer(french(lower)))
    )


def sector(text: Column, language: Column) -> Column:
    french = lambda lower: keyword_scores(lower, lx.SECTORS_FR)
    arabic = keyword_scores(text, lx.SECTORS_AR, fold=False)
    mixed = _sum(keyword_scores(text, lx.SECTORS_FR, fold=False), arabic)

    named = lambda score, name, total: F.when(score > 0, name).otherwise(lx.SECTOR_DEFAULT)
    answer = lambda scores: with_scores(scores, named)
    return F.when(language == "ar", answer(arabic)).when(language == "mixed", answer(mixed)).otherwise(
        once(F.lower(text), lambda lower: answer(french(lower)))
    )


def metadata_type(text: Column) -> Column:
    return first_best(pattern_scores(text, lx.METADATA_TYPES))["class"]


def metadata_category(text: Column) -> Column:
    return first_best(pattern_scores(text, lx.METADATA_CATEGORIES))["class"]


def metadata_department(text: Column) -> Column:
    return first_best(pattern_scores(text, lx.METADATA_DEPARTMENTS))["class"]


def status(text: Column) -> Column:
    """The first status, in their order, that a word of the text states."""
    found = F.when(F.lit(False), "")
    for name, pattern in lx.STATUSES.items():
        found = found.when(text.rlike(rx(pattern, True)), name)
    return found.otherwise("unknown")


#: Terms of a user's lexicon that are broadcast at once; more of them go in blocks of this size.
TERM_BLOCK = 20_000


def classify_with(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The best class of each document by a user's lexicon (class, ord, term, weight).

    Terms are looked for anywhere in a text, so there is no key to join on: each block of terms is broadcast, and the scores of
    all blocks are added. Ties go to the lower ``ord``; documents without any term get no row.
    """
    terms = lexicon.select("class", "ord", F.lower("term").alias("term"), "weight")
    n_blocks = max(1, -(-terms.count() // TERM_BLOCK))
    text = F.lower(F.col(text_col))
    n = (F.length(text) - F.length(F.replace(text, F.col("term"), F.lit("")))) / F.length("term")

    def part(block: int) -> DataFrame:
        mine = terms if n_blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == block)
        hits = docs.select(id_col, text_col).join(F.broadcast(mine), F.contains(text, F.col("term")))
        return hits.groupBy(id_col, "class", "ord").agg(F.sum(n * F.col("weight")).alias("score"))

    parts = reduce(DataFrame.unionByName, [part(block) for block in range(n_blocks)])
    scores = parts if n_blocks == 1 else parts.groupBy(id_col, "class", "ord").agg(F.sum("score").alias("score"))
    best = F.max_by(F.struct("class", "score"), F.struct(F.col("score"), -F.col("ord")))
    return scores.groupBy(id_col).agg(best.alias("best")).select(id_col, "best.class", "best.score")


# --- rule-ordered classes -----------------------------------------------------------------------------------


def block_type(text: Column, font_size: Column) -> Column:
    """header, footer, list, table or body, for a block of a page."""
    held = strip(text)
    first = F.slice(F.split(held, "\n"), 1, 3)
    tabular = (F.size(F.split(held, "\n")) > 2) & F.forall(first, lambda s: F.size(words(s)) > 3)
    multi = lambda patterns: held.rlike("(?Um)" + "|".join(rf"\A(?:{p[1:]})" for p in patterns))
    return (
        F.when((font_size > 14) | multi(lx.BLOCK_HEADERS), "header")
        .when(multi(lx.BLOCK_FOOTERS), "footer")
        .when(starts(held, (r"\s*[-•▪▫◦‣⁃]\s+", r"\s*\d+\.\s+")), "list")
        .when(tabular, "table")
        .otherwise("body")
    )


def paragraph_type(text: Column, style: Column, heading_level: Column) -> Column:
    """heading, list_item, toc, reference or body, for a paragraph of a word-processor document."""
    lower = strip(F.lower(text))
    toc = F.contains(lower, F.lit("table")) & (F.contains(lower, F.lit("contents")) | F.contains(lower, F.lit("matières")))
    return (
        F.when((heading_level > 0) | F.contains(F.lower(style), F.lit("heading")), "heading")
        .when(starts(strip(text), lx.PARAGRAPH_HEADINGS, True), "heading")
        .when(starts(text, (r"\s*[-•▪▫◦‣⁃*]\s+", r"\s*\d+[.)]\s+", r"\s*[a-zA-Z][.)]\s+")), "list_item")
        .when(toc, "toc")
        .when(lower.rlike(r"\A(?:ref:|référence:|source:)"), "reference")
        .otherwise("body")
    )


def section_type(title: Column, content: Column) -> Column:
    """The type of a section by its title, the first 200 characters of its content, and its length."""
    title, opening = F.lower(title), F.substring(F.lower(content), 1, 200)
    found = F.when(F.lit(False), "")
    special = {"toc": lx.TOC_PATTERNS, "bibliography": lx.BIBLIOGRAPHY_PATTERNS, "appendix": lx.APPENDIX_PATTERNS}
    for name, patterns in special.items():
        either = rx("|".join(patterns), True)
        found = found.when(title.rlike(either) | opening.rlike(either), name)
    has = lambda *terms: title.rlike("|".join(terms))
    return (
        found.when(has("introduction", "مقدمة"), "introduction")
        .when(has("conclusion", "خاتمة"), "conclusion")
        .when(title.rlike(rx(r"chapitre\s+\d+|فصل\s+\d+")), "chapter")
        .when(title.rlike(rx(r"section\s+\d+|قسم\s+\d+")), "section")
        .when(title.rlike(rx(r"article\s+\d+|مادة\s+\d+")), "article")
        .when(F.size(words(content)) > 500, "main_content")
        .otherwise("content")
    )


def type_of_structure(types: Column) -> Column:
    """The document's type from the array of its sections' types."""
    n = F.size(types)
    holds = lambda name: F.array_contains(types, name)
    return (
        F.when(holds("article") & (n > 10), "regulation")
        .when(holds("chapter") | (holds("toc") & (n > 15)), "book")
        .when(holds("bibliography"), "report")
        .when(n < 5, "memo")
        .otherwise("document")
    )


def is_title_like(line: Column) -> Column:
    """At least three of six signs of a title."""
    held = strip(line)
    signs = (
        (F.upper(held) == held) & held.rlike(r"\p{Lu}"),
        F.size(words(held)) < 15,
        ~held.endswith("."),
        ~held.rlike(r"\A\d+\."),
        ~held.startswith("Page "),
        ~held.startswith("صفحة "),
    )
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 3


def title(text: Column) -> Column:
    """The first title-like line of ten, else the first of five lines of 20 to 200 characters, else nothing."""
    lines = F.transform(F.split(text, "\n"), strip)
    likely = F.filter(F.slice(lines, 1, 10), lambda s: (F.length(s) >= 10) & is_title_like(s))
    fallback = F.filter(F.slice(lines, 1, 5), lambda s: F.length(s).between(20, 200))
    return F.coalesce(F.get(likely, F.lit(0)), F.get(fallback, F.lit(0)), F.lit(""))


def structure_counters(text: Column) -> dict[str, Column]:
    def total(patterns) -> Column:
        return sum((count(text, p, True) for p in patterns), F.lit(0))

    return {
        "has_toc": text.rlike(rx("|".join(lx.TOC_PATTERNS), True)),
        "section_count": total(lx.SECTION_PATTERNS),
        "table_count": total(lx.TABLE_PATTERNS),
        "figure_count": total(lx.FIGURE_PATTERNS),
        "reference_count": total(lx.REFERENCE_PATTERNS),
    }


def version(text: Column) -> Column:
    """The number after the first of four version marks that occurs, by their order; else nothing."""
    found = [F.nullif(F.regexp_extract(text, rx(p, True), 1), F.lit("")) for p in lx.VERSION_PATTERNS]
    return F.coalesce(*found, F.lit(""))
