"""Sections, hierarchy, reading order and quality of a document's structure.

A document's lines, sections and parents are arrays within its row: cutting, numbering and linking them are array
functions, so no line is ever shuffled. Only sections that are wanted as rows are exploded.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from foliant.functions import lexicons as lx
from foliant.functions.classify import section_type, type_of_structure
from foliant.functions.entities import section_keywords
from foliant.functions.language import section_language
from foliant.functions.text import once, rx, starts, strip, words

MIN_SECTION = 50
MIN_TEXT = 100
TOC_TYPES = ("heading", "chapter", "section")

SECTION = "struct<title: string, content: string, level: int, start: int, end: int>"


def heading_level(line: Column, language: str | None = None, strict: bool = False) -> Column:
    """The level of a stripped line as a heading, null if it is none.

    ``strict`` leaves out the patterns which, ignoring case, take any short line of words for a heading.
    """
    patterns = lx.HEADINGS.get(language, ()) + lx.HEADINGS["universal"]
    loose = (lx.HEADINGS["universal"][1], lx.HEADINGS["french"][2])
    others = [p for p in patterns if p != lx.NUMBERED_HEADING and not (strict and p in loose)]
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    capitals = (
        (F.upper(line) == line)
        & line.rlike(r"\p{Lu}")
        & F.length(line).between(10, 100)
        & ~line.endswith(".")
        & (F.size(words(line)) <= 10)
    )
    found = F.when(line == "", F.lit(None).cast("int")).when(
        starts(line, (lx.NUMBERED_HEADING,), True), F.least(dots + 1, F.lit(6))
    )
    # A pattern with a name of level 1 in it decides before the fallback on capitals.
    if others:
        found = found.when(starts(line, others, True), F.lit(1))
    return found.when(capitals, F.lit(2))


def cut_sections(text: Column, language: str | None = None, least: int = MIN_SECTION, strict: bool = False) -> Column:
    """Array of sections: each heading is one, and so is what lies between two if it is long enough."""
    raw = F.split(F.coalesce(text, F.lit("")), "\n")

    def from_lines(lines: Column) -> Column:
        levels = F.transform(lines, lambda s: heading_level(strip(s), language, strict))
        return once(levels, lambda held: from_levels(lines, held))

    def from_levels(lines: Column, levels: Column) -> Column:
        n = F.size(lines)
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(levels, i).isNotNull())
        bounds = F.arrays_zip(
            F.concat(F.array(F.lit(-1)), places).alias("before"), F.concat(places, F.array(n)).alias("at")
        )

        def pieces(b: Column) -> Column:
            start, end = b["before"] + 1, b["at"]
            content = strip(F.array_join(F.slice(lines, start + 1, end - start), "\n"))
            between = F.struct(
                F.when(end == n, "Final Section").alias("title"),
                content.alias("content"),
                F.lit(1).alias("level"),
                start.alias("start"),
                end.alias("end"),
            )
            line = strip(F.get(lines, end))
            heading = F.struct(
                line.alias("title"),
                line.alias("content"),
                F.get(levels, end).alias("level"),
                end.alias("start"),
                (end + 1).alias("end"),
            )
            none = F.array().cast(f"array<{SECTION}>")
            return F.concat(
                F.when((end > start) & (F.length(content) >= least), F.array(between)).otherwise(none),
                F.when(end < n, F.array(heading)).otherwise(none),
            )

        return F.flatten(F.transform(bounds, pieces))

    blank = F.transform(raw, lambda s: F.when(strip(s) == "", F.lit("")).otherwise(s))
    found = once(blank, from_lines)
    numbered = F.transform(
        found,
        lambda s, i: F.struct(
            F.concat(F.lit("section_"), i.cast("string")).alias("id"),
            F.coalesce(s["title"], F.concat(F.lit("Section "), i.cast("string"))).alias("title"),
            *[s[name].alias(name) for name in ("content", "level", "start", "end")],
        ),
    )
    return numbered


def parents(levels: Column) -> Column:
    """For each section the place of its parent, or -1.

    Slot k of the state holds the latest section of level k that no section of a lower level has followed; a section
    of level L hangs under slot L - 2, of which there is none for levels 1 and 2.
    """
    zero = F.struct(F.array_repeat(F.lit(-1), 8).alias("slots"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        place = F.size(s["out"])
        up = F.when(level >= 3, F.get(s["slots"], level - 2)).otherwise(F.lit(-1))
        slots = F.transform(
            s["slots"], lambda old, k: F.when(k < level, old).when(k == level, place).otherwise(F.lit(-1))
        )
        return F.struct(slots.alias("slots"), F.array_append(s["out"], up).alias("out"))

    return F.aggregate(levels, zero, step, lambda s: s["out"])


def depths(up: Column) -> Column:
    """For each section its depth under the parents of ``parents``."""
    return F.aggregate(
        up,
        F.array().cast("array<int>"),
        lambda out, p: F.array_append(out, F.when(p < 0, F.lit(1)).otherwise(F.get(out, p) + 1)),
    )


@F.arrow_udf(ArrayType(IntegerType()))
def reading_order(levels: pa.Array, ups: pa.Array) -> pa.Array:
    """The places of sections, generation by generation of the graph of parents and close neighbours."""

    def order(level: list[int], up: list[int]) -> list[int]:
        after = [dict() for _ in level]
        for child, parent in enumerate(up):
            if parent >= 0:
                after[parent][child] = None
        for here in range(len(level) - 1):
            if abs(level[here] - level[here + 1]) <= 1:
                after[here][here + 1] = None
        waits = [0] * len(level)
        for followers in after:
            for child in followers:
                waits[child] += 1
        ready, out = deque(i for i, n in enumerate(waits) if not n), []
        while ready:
            here = ready.popleft()
            out.append(here)
            for child in after[here]:
                waits[child] -= 1
                if not waits[child]:
                    ready.append(child)
        return out

    found = [order(a or [], b or []) for a, b in zip(levels.to_pylist(), ups.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.int32()))


def section_summary(text: Column, limit: int = 200) -> Column:
    """Sentences by place and length, best first, until the next one would exceed ``limit``."""
    found = F.transform(
        F.filter(F.split(text, "[.!?؟۔]+"), lambda s: (strip(s) != "") & (F.length(s) > 20)), strip
    )
    scored = F.transform(
        found,
        lambda s, i: F.struct(
            (-(F.lit(0.7) / (i + 1) + F.least(F.length(s) / 100, F.lit(1.0)) * 0.3)).alias("score"),
            i.alias("place"),
            s.alias("sentence"),
        ),
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        fits = ~s["full"] & (F.length(s["out"]) + F.length(x["sentence"]) <= limit)
        return F.struct(
            F.when(fits, F.concat(s["out"], x["sentence"], F.lit(". "))).otherwise(s["out"]).alias("out"),
            (~fits).alias("full"),
        )

    chosen = F.aggregate(F.sort_array(scored), zero, step, lambda s: strip(s["out"]))
    return (
        F.when(F.length(text) <= limit, text).when(F.size(found) == 0, F.substring(text, 1, limit)).otherwise(chosen)
    )


def with_sections(docs: DataFrame, text_col: str = "text", language: str | None = None) -> DataFrame:
    """``docs`` with arrays ``sections``, ``parents`` and ``depths``. Short texts have no sections."""
    text = F.col(text_col)
    enough = F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_TEXT
    cut = F.when(enough, cut_sections(text, language)).otherwise(F.array())
    docs = docs.withColumn("sections", cut)
    docs = docs.withColumn("parents", parents(F.col("sections.level")))
    return docs.withColumn("depths", depths(F.col("parents")))


def section_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: str | None = None) -> DataFrame:
    """One row a section, with its type, language, keywords, summary and parent."""
    held = with_sections(docs, text_col, language)
    rows = held.select(id_col, "parents", "depths", F.posexplode_outer("sections").alias("ordinal", "s")).where("s IS NOT NULL")
    up = F.get("parents", F.col("ordinal"))
    content = F.col("s.content")
    return rows.select(
        id_col,
        "ordinal",
        "s.id",
        "s.title",
        content.alias("content"),
        "s.level",
        F.col("s.start").alias("start_position"),
        F.col("s.end").alias("end_position"),
        F.when(up >= 0, F.concat(F.lit("section_"), up.cast("string"))).alias("parent_id"),
        F.get("depths", F.col("ordinal")).alias("depth"),
        section_type(F.col("s.title"), content).alias("section_type"),
        section_language(content).alias("language"),
        section_keywords(content).alias("keywords"),
        F.when(F.length(content) > 500, section_summary(content)).otherwise("").alias("summary"),
    )


def table_of_contents(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sections of the table of contents as rows (id, parent, ordinal, page)."""
    listed = sections.where(F.col("section_type").isin(*TOC_TYPES))
    page = F.floor(F.col("start_position") / 50) + 1
    return listed.select(id_col, "id", "parent_id", "title", "level", page.cast("int").alias("page"), "ordinal")


def _deviation(values: Column) -> tuple[Column, Column]:
    n = F.size(values)
    average = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / n
    return average, F.greatest(F.lit(0.0), square - average * average)


def structure_quality(sections: Column) -> Column:
    """Mean of heading share, evenness of levels, evenness of lengths and a bonus for special sections.

    ``sections``: structs with section_type, level and content length ``chars``. 0 without sections.
    """
    n = F.size(sections)
    headings = F.size(F.filter(sections, lambda s: s["section_type"].isin(*TOC_TYPES)))
    special = F.size(F.filter(sections, lambda s: s["section_type"].isin("introduction", "conclusion", "toc")))
    average, variance = _deviation(F.transform(sections, lambda s: s["level"].cast("double")))
    lengths = F.transform(F.filter(sections, lambda s: s["section_type"] == "content"), lambda s: s["chars"].cast("double"))
    length_mean, length_variance = _deviation(lengths)
    base = (
        F.least(headings / n * 2, F.lit(1.0))
        + F.greatest(F.lit(0.0), 1.0 - F.sqrt(variance) / average)
        + F.least(special * 0.2, F.lit(0.4))
    )
    evenness = F.greatest(F.lit(0.0), 1.0 - F.try_divide(length_variance, length_mean * length_mean))
    return F.when(n == 0, 0.0).when(F.size(lengths) > 0, (base + evenness) / 4).otherwise(base / 3)


def document_structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: str | None = None) -> DataFrame:
    """One row a document: type, depth, sections, quality, language shares and reading order."""
    held = with_sections(docs, text_col, language)
    typed = F.transform(
        "sections",
        lambda s: F.struct(
            section_type(s["title"], s["content"]).alias("section_type"),
            s["level"].alias("level"),
            F.length(s["content"]).alias("chars"),
            section_language(s["content"]).alias("language"),
        ),
    )
    held = held.withColumn("typed", typed)
    n = F.size("sections")
    shares = F.map_from_entries(
        F.transform(
            F.sort_array(F.array_distinct(F.col("typed.language"))),
            lambda name: F.struct(name, F.size(F.filter("typed", lambda s: s["language"] == name)) / n),
        )
    )
    order = reading_order(F.col("sections.level"), F.col("parents"))
    ids = F.transform(order, lambda i: F.concat(F.lit("section_"), i.cast("string")))
    return held.select(
        id_col,
        F.when(n == 0, "unknown").otherwise(type_of_structure(F.col("typed.section_type"))).alias("document_type"),
        F.when(n == 0, 0).otherwise(F.array_max("depths")).alias("max_depth"),
        n.alias("total_sections"),
        structure_quality(F.col("typed")).alias("structure_quality"),
        shares.alias("language_distribution"),
        ids.alias("reading_order"),
    )


def to_markdown(structure: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One Markdown report a document. A document's sections come together as the rows of its report."""
    c = F.col
    indent = F.repeat(F.lit("  "), c("depth") - 1)
    entry = F.when(
        c("section_type").isin(*TOC_TYPES),
        F.concat(indent, F.lit("- ["), c("title"), F.lit("](#section-"), c("id"), F.lit(")")),
    )
    keywords = F.when(F.size("keywords") > 0, F.concat(F.lit("- **Keywords**: "), F.array_join("keywords", ", ")))
    summary = F.when(c("summary") != "", F.concat(F.lit("- **Summary**: "), c("summary")))
    part = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), c("title"), F.lit(" {#section-"), c("id"), F.lit("}")),
        F.concat(F.lit("- **Type**: "), c("section_type")),
        F.concat(F.lit("- **Level**: "), c("level").cast("string")),
        F.concat(F.lit("- **Language**: "), c("language")),
        keywords,
        summary,
        F.lit(""),
    )
    rows = sections.select(id_col, F.struct("ordinal", entry.alias("entry"), part.alias("part")).alias("s"))
    gathered = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("s")).alias("s"))
    entries = F.array_compact(F.col("s.entry"))
    head = F.concat_ws(
        "\n",
        F.lit("# Document Structure Analysis"),
        F.concat(F.lit("- **Document Type**: "), c("document_type")),
        F.concat(F.lit("- **Total Sections**: "), c("total_sections").cast("string")),
        F.concat(F.lit("- **Max Depth**: "), c("max_depth").cast("string")),
        F.concat(F.lit("- **Structure Quality**: "), F.format_string("%.2f", "structure_quality")),
        F.lit(""),
    )
    toc = F.when(F.size(entries) > 0, F.concat_ws("\n", F.lit("## Table of Contents"), F.array_join(entries, "\n"), F.lit("")))
    body = F.when(F.size("s") > 0, F.concat_ws("\n", F.lit("## Sections"), F.array_join(F.col("s.part"), "\n")))
    return structure.join(gathered, id_col, "left").select(id_col, F.concat_ws("\n", head, toc, body).alias("markdown"))


def to_html(structure: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One HTML summary a document, with its table of contents as a list."""
    c = F.col
    item = F.concat(F.lit("<li><a href='#section-"), c("id"), F.lit("'>"), c("title"), F.lit("</a></li>"))
    rows = sections.where(c("section_type").isin(*TOC_TYPES)).select(id_col, F.struct("ordinal", item.alias("item")).alias("s"))
    gathered = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("s")).alias("s"))
    line = lambda name, value: F.concat(F.lit(f"<p><strong>{name}:</strong> "), value, F.lit("</p>"))
    toc = F.when(
        F.size("s") > 0, F.concat(F.lit("<h2>Table of Contents</h2>\n<ul>\n"), F.array_join(F.col("s.item"), "\n"), F.lit("\n</ul>"))
    )
    html = F.concat_ws(
        "\n",
        F.lit("<!DOCTYPE html>\n<html><head><title>Document Structure</title></head><body>"),
        F.lit("<h1>Document Structure Analysis</h1>\n<div class='summary'>"),
        line("Document Type", c("document_type")),
        line("Total Sections", c("total_sections").cast("string")),
        line("Max Depth", c("max_depth").cast("string")),
        line("Structure Quality", F.format_string("%.2f", "structure_quality")),
        F.lit("</div>"),
        toc,
        F.lit("</body></html>"),
    )
    return structure.join(gathered, id_col, "left").select(id_col, html.alias("html"))
