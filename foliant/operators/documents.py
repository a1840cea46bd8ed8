"""Whole-document analysis, batches of it, metadata, and the reports made from their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import classify, entities, language, quality
from foliant.functions.text import strip, text_or_empty, words


def analyse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with language, type, confidence, sector, entities, references and keywords.

    A text of no known language has the status ``error``, as its keywords can't be found; its other results are null.
    """
    text = F.col(text_col)
    docs = docs.withColumn("language", language.french_or_arabic(text))
    lang = F.col("language")
    docs = docs.withColumn("_type", classify.document_type(text, lang))
    found = {
        "type_document": F.col("_type.type"),
        "confidence_score": F.col("_type.confidence"),
        "secteur": classify.sector(text, lang),
        "personnes": entities.persons(text, lang),
        "lieux": entities.places(text, lang),
        "organisations": entities.organisations(text, lang),
        "dates": entities.dates(text, lang),
        "numeros_reference": entities.references(text, lang),
        "mots_cles": entities.keywords(text, lang),
    }
    known = lang != "unknown"
    docs = docs.withColumns({name: F.when(known, value) for name, value in found.items()}).drop("_type")
    docs = docs.withColumn("processing_status", F.when(known, "success").otherwise("error"))
    total = entities.entity_total(*[F.col(c) for c in ("personnes", "lieux", "organisations", "dates")])
    return docs.withColumn("entities_total", F.when(known, total)).withColumn("text_length", F.length(text))


def with_default_ids(docs: DataFrame, order_col: str) -> DataFrame:
    """Ids ``doc_n`` and names ``document_n.txt`` where a row has none, by its place in ``order_col``."""
    place = (F.col(order_col) + 1).cast("string")
    return docs.withColumns(
        {
            "document_id": F.coalesce(F.col("id"), F.concat(F.lit("doc_"), place)),
            "filename": F.coalesce(F.col("filename"), F.concat(F.lit("document_"), place, F.lit(".txt"))),
        }
    )


def batch_info(results: DataFrame) -> DataFrame:
    """One row: how many results there are, how many went well, and the share in percent."""
    good = F.count_if(F.col("processing_status") == "success")
    return results.agg(
        F.count("*").alias("total_documents"),
        good.alias("successful_analyses"),
        (F.count("*") - good).alias("failed_analyses"),
        F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def metadata(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with title, classes, counters, languages, version, status, keywords and scores."""
    text = text_or_empty(F.col(text_col))
    docs = docs.withColumns(
        {
            "title": classify.title(text),
            "document_type": classify.metadata_type(text),
            "document_category": classify.metadata_category(text),
            "ministry_department": classify.metadata_department(text),
            "version": classify.version(text),
            "status": classify.status(text),
            "word_count": F.size(words(text)),
            "character_count": F.length(text),
            "keywords": entities.metadata_keywords(text),
            "_dates": entities.typed_dates(text),
            **classify.structure_counters(text),
            **language.content_languages(text),
        }
    )
    confidence = quality.metadata_confidence(
        F.col("character_count"), F.col("document_type"), F.col("primary_language"), F.col("section_count"), F.col("title")
    )
    return docs.withColumns(
        {
            "approval_date": F.col("_dates.approval_date"),
            "effective_date": F.col("_dates.effective_date"),
            "text_creation_date": F.col("_dates.creation_date"),
            "quality_score": quality.metadata_quality(text),
            "readability_score": quality.metadata_readability(text),
            "confidence_score": confidence,
        }
    ).drop("_dates")


#: Property names that stand for a field; a later one overrides. Fixed values.
PROPERTY_ALIASES = {
    "title": ("title",),
    "author": ("author", "creator"),
    "subject": ("subject",),
    "keywords": ("keywords",),
    "creation_date": ("creation_date", "creationDate"),
    "modification_date": ("modification_date", "modDate"),
    "language": ("language",),
}


def map_properties(properties: Column) -> dict[str, Column]:
    """Fields from a map of document properties; empty ones don't count."""
    held = lambda name: F.nullif(F.try_element_at(properties, F.lit(name)), F.lit(""))
    return {field: F.coalesce(*[held(name) for name in reversed(names)]) for field, names in PROPERTY_ALIASES.items()}


def merge_maps(*sources: Column) -> Column:
    """Maps laid over each other; the last one that has a key counts, even with null."""
    empty = F.create_map().cast("map<string,string>")
    merged = empty
    for source in sources:
        source = F.coalesce(source, empty)
        merged = F.map_concat(_without(merged, source), source)
    return merged


def _without(held: Column, other: Column) -> Column:
    return F.map_filter(held, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def report_slices() -> dict[str, Column]:
    """What a printed report shows of each list."""
    shown = {"personnes": 5, "lieux": 5, "dates": 5, "organisations": 5, "numeros_reference": 3, "mots_cles": 8}
    return {name: F.slice(F.col(name), 1, n) for name, n in shown.items()}


#: Names of languages as reports show them. Fixed values.
LANGUAGE_NAMES = {"fr": "Français", "ar": "العربية", "mixed": "Mixte (Fr/Ar)", "unknown": "Inconnue"}


def report_text() -> Column:
    """The printed report of an analysed document, as one string."""
    name = F.col("language")
    for code, shown in LANGUAGE_NAMES.items():
        name = F.when(F.col("language") == code, shown).otherwise(name)
    readable = lambda c: F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))
    titles = {
        "personnes": "Personnes identifiées",
        "lieux": "Lieux mentionnés",
        "dates": "Dates trouvées",
        "organisations": "Organisations",
        "numeros_reference": "Références",
        "mots_cles": "Mots-clés principaux",
    }
    lists = [
        F.concat(
            F.lit(f"{titles[c]} ("),
            F.size(F.col(c)).cast("string"),
            F.lit("):"),
            F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n   • "), x)), ""),
        )
        for c, items in report_slices().items()
    ]
    return F.concat_ws(
        "\n",
        F.lit("RAPPORT D'ANALYSE DOCUMENTAIRE BILINGUE"),
        F.concat(F.lit("Langue: "), name),
        F.concat(F.lit("Type de document: "), readable("type_document")),
        F.concat(F.lit("Confiance: "), F.format_string("%.1f%%", F.col("confidence_score"))),
        F.concat(F.lit("Secteur: "), readable("secteur")),
        *lists,
    )


# --- files, batches, timing ------------------------------------------------------------------------------


def group_by_type(files: DataFrame, key: str = "extension") -> DataFrame:
    """For each type how many there are and how many are processed."""
    return files.groupBy(key).agg(F.count("*").alias("total"), F.count_if("processed").alias("processed"))


def timing(entries: DataFrame, value: str = "processing_time") -> DataFrame:
    """Total, mean, least and most of the times that aren't zero or missing; zeros if there are none."""
    t = F.when(F.col(value) != 0, F.col(value))
    zero = F.lit(0.0)
    return entries.agg(
        F.coalesce(F.sum(t), zero).alias("total_time"),
        F.coalesce(F.avg(t), zero).alias("average_time"),
        F.coalesce(F.min(t), zero).alias("min_time"),
        F.coalesce(F.max(t), zero).alias("max_time"),
    )


def processing_statistics(entries: DataFrame) -> DataFrame:
    done = F.count_if("processed")
    return entries.agg(
        F.count("*").alias("total_files"),
        done.alias("processed_files"),
        (F.count("*") - done).alias("remaining_files"),
        F.coalesce(F.try_divide(done * 100.0, F.count("*")), F.lit(0.0)).alias("completion_rate"),
    )


def human_size(size: Column) -> Column:
    """Bytes in the largest of five units of 1024, with two places at most and one at least."""
    names = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    power = sum(((size >= 1024**i).cast("int") for i in range(1, 5)), F.lit(0))
    scaled = F.bround(size / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.format_string("%.2f", scaled), "0$", "")
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", shown, F.get(names, power)))


def content_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Hashes that several rows share, with their number and least id."""
    digest = F.md5(F.col(text_col).cast("binary")).alias("content_md5")
    return docs.groupBy(digest).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


# --- pages, tables and paragraphs ------------------------------------------------------------------------


def page_text(blocks: Column, formatted: bool = True) -> Column:
    """A page's text from its blocks (text, type): headers, bodies, lists, tables; footers are left out."""
    if not formatted:
        return strip(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))
    marks = {"header": ("# ", "\n"), "body": ("", "\n"), "list": ("", "\n"), "table": ("[TABLE]\n", "\n[/TABLE]\n")}
    parts = [
        F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: F.concat(F.lit(before), b["text"], F.lit(after)))
        for kind, (before, after) in marks.items()
    ]
    return strip(F.array_join(F.concat(*parts), "\n"))


def pages_text(pages: Column) -> Column:
    """A document's text from its pages (number, text), each under its mark."""
    return F.array_join(
        F.transform(pages, lambda p: F.concat(F.lit("\n--- Page "), p["number"].cast("string"), F.lit(" ---\n"), p["text"])), ""
    )


def is_scanned(text: Column, n_images: Column, threshold: int = 100) -> Column:
    """Struct of whether a page is an image of text, and how sure that is."""
    scanned = (F.length(strip(text)) < threshold) & (n_images > 0)
    return F.struct(scanned.alias("is_scanned"), F.when(scanned, 0.9).otherwise(0.8).alias("confidence"))


def extraction_status(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "success").when(confidence >= 0.5, "partial").otherwise("failed")


def word_status(text: Column) -> Column:
    n = F.length(strip(text))
    return F.when(n > 100, "success").when(n > 0, "partial").otherwise("failed")


def table_text(rows: Column, formatted: bool = True) -> Column:
    """Rows of cells as a marked Markdown table, short rows padded; or tab-separated."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    if not formatted:
        return F.array_join(F.transform(padded, lambda r: F.array_join(r, "\t")), "\n")
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|\n"))
    body = F.transform(padded, lambda r, i: F.when(i == 0, F.concat(line(r), rule)).otherwise(line(r)))
    return F.concat(F.lit("[TABLE]\n"), F.array_join(body, ""), F.lit("[/TABLE]\n"))


def word_text(elements: Column) -> Column:
    """A word-processor document's text from its elements (type, text, heading_level)."""

    def part(e: Column) -> Column:
        text = e["text"]
        return (
            F.when(e["type"] == "heading", F.concat(F.repeat(F.lit("#"), e["heading_level"]), F.lit(" "), text, F.lit("\n\n")))
            .when(e["type"] == "list_item", F.concat(F.lit("• "), text, F.lit("\n")))
            .when(e["type"] == "table", F.concat(text, F.lit("\n")))
            .otherwise(F.concat(text, F.lit("\n\n")))
        )

    return F.array_join(F.transform(elements, part), "")


def best_fallback(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document's extraction results the primary one, or if that failed with under 50 characters a better one.

    A successful alternative counts before the longest partial one.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    rank = F.struct(
        (F.col("primary") & ~((F.col("status") == "failed") & (n < 50))).alias("primary"),
        (F.col("status") == "success").alias("success"),
        n.alias("n"),
    )
    best = results.groupBy(key).agg(F.max_by(F.struct("text", "status", "primary"), rank).alias("best"))
    method = F.when(F.col("best.primary"), "native").otherwise("fallback")
    return best.select(key, "best.text", "best.status", method.alias("extraction_method"))
