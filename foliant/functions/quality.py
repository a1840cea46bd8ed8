"""Quality, readability and confidence scores.

The composite checks take the statistics they need as columns, so that a caller computes each once:
``with_statistics`` adds them to a DataFrame, and the scores are then plain arithmetic on them. Fixed steps are summed as
whole tenths or hundredths, so that they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions.language import simple_language
from foliant.functions.text import (
    bare_words,
    count,
    mean,
    rounded,
    rx,
    sentences,
    sentences_by_dot,
    sentences_metadata,
    strip,
    words,
)

STATISTICS = (
    "char_count", "alpha_count", "digit_count", "space_count", "punct_count", "special_count", "word_count",
    "unique_words", "sentence_count", "alpha_ratio", "special_char_ratio", "avg_word_length", "avg_sentence_length",
    "vocabulary_ratio",
)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the fourteen statistics of the stripped text, and its words and sentences as arrays."""
    held = docs.withColumn("_text", strip(F.coalesce(F.col(text_col), F.lit(""))))
    text = F.col("_text")
    held = held.withColumns({"_words": bare_words(text), "_sentences": sentences(text)})
    counts = held.withColumns(
        {
            "char_count": F.length(text),
            "alpha_count": count(text, r"\p{L}"),
            "digit_count": count(text, r"\p{Nd}"),
            "space_count": count(text, r"\s"),
            "punct_count": F.length(text) - F.length(F.translate(text, lx.DETECTOR_PUNCTUATION, "")),
            "word_count": F.size("_words"),
            "unique_words": F.size(F.array_distinct("_words")),
            "sentence_count": F.size("_sentences"),
            "avg_word_length": F.coalesce(mean(F.transform("_words", lambda w: F.length(w).cast("double"))), F.lit(0.0)),
        }
    )
    special = F.col("char_count") - F.col("alpha_count") - F.col("digit_count") - F.col("space_count") - F.col("punct_count")
    return counts.withColumn("special_count", special).withColumns(
        {
            "alpha_ratio": ratio(F.col("alpha_count"), F.col("char_count")),
            "special_char_ratio": ratio(F.col("special_count"), F.col("char_count")),
            "avg_sentence_length": ratio(F.col("word_count"), F.col("sentence_count")),
            "vocabulary_ratio": ratio(F.col("unique_words"), F.col("word_count")),
        }
    )


def _issues(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for test, name in found]))


def basic_issues() -> Column:
    """Array of what is wrong by the statistics; an empty text has one issue."""
    c = F.col
    found = _issues(
        (c("char_count") < 10, "text_too_short"),
        (c("alpha_ratio") < 0.7, "low_alphabetic_content"),
        (c("special_char_ratio") > 0.2, "high_special_character_ratio"),
        (c("avg_word_length") < 2.0, "words_too_short"),
        (c("avg_word_length") > 15.0, "words_too_long"),
        (c("avg_sentence_length") < 3, "sentences_too_short"),
        (c("avg_sentence_length") > 50, "sentences_too_long"),
    )
    return F.when(c("char_count") == 0, F.array(F.lit("empty_text"))).otherwise(found)


def basic_score(n_issues: Column) -> Column:
    c = F.col
    alpha = F.when(c("alpha_ratio") < 0.5, -20).when(c("alpha_ratio") > 0.9, 10).otherwise(0)
    vocabulary = F.when(c("vocabulary_ratio") > 0.5, 10).when(c("vocabulary_ratio") < 0.2, -10).otherwise(0)
    return F.when(c("char_count") == 0, 0.0).otherwise(clamp((100 - n_issues * 15 + alpha + vocabulary) / 100))


def basic_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, issues, score and validity."""
    checked = with_statistics(docs, text_col).withColumn("issues", basic_issues())
    checked = checked.withColumn("score", basic_score(F.size("issues")))
    return checked.withColumn("valid", (F.col("score") > 0.5) & (F.size("issues") < 3))


def artifact_issues(text: Column) -> Column:
    broken = count(text, r"\b\w{1,2}\s+\w{1,2}\b")
    return _issues(
        (text.rlike(rx(r"\s{5,}")), "excessive_whitespace"),
        (broken > F.size(words(text)) * 0.1, "broken_words"),
        (text.rlike(rx(r"page\s+\d+|©|\d+/\d+", True)), "header_footer_artifacts"),
        (text.rlike(rx(r"\|\s*\||\t{3,}")), "table_artifacts"),
        (text.rlike(r"(?Um)^[\s•\-\*]{2,}"), "formatting_artifacts"),
    )


def has_encoding_issues(text: Column) -> Column:
    return text.rlike("�|Ã¡|Ã©|Ã­|Ã³|Ãº|â€™|â€œ|â€\u009d")


def ocr_issues(text: Column) -> Column:
    found = bare_words(F.lower(text))
    odd = F.filter(found, lambda w: (F.length(w) > 2) & w.rlike(r"[^\p{L}]"))
    return _issues(
        (text.rlike(rx(r"\b[Il1|]{2,}\b")), "character_confusion"),
        (text.rlike(rx(r"\brn\b")), "rn_m_confusion"),
        (text.rlike(rx(r"\bvv\b")), "vv_w_confusion"),
        (text.rlike(rx(r"\b[O0]{2,}\b")), "o_zero_confusion"),
        (count(text, r"\b\w\b") > F.size(words(text)) * 0.15, "excessive_single_characters"),
        ((F.size(found) > 0) & (F.size(odd) > F.size(found) * 0.2), "suspicious_character_sequences"),
    )


def has_plain_sentence(text: Column) -> Column:
    """Whether, before some terminator, a capital is followed by a small letter; each piece is read once."""
    pieces = F.split(text, "[.!?]", -1)
    ended = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.exists(ended, lambda p: p.rlike("(?s)^[^A-Z]*+[A-Z][^a-z]*+[a-z]"))


def structure_score(text: Column) -> Column:
    """Paragraphs add a tenth, the lack of a plain sentence takes a fifth.

    The share of properly ended sentences, which the rest is added to, is nil by construction: sentences
    are what stands between terminators.
    """
    paragraphs = F.when(F.contains(text, F.lit("\n\n")), 0.1).otherwise(0.0)
    plain = F.when(has_plain_sentence(text), 0.0).otherwise(-0.2)
    return F.when(F.size(sentences(text)) == 0, 0.0).otherwise(clamp(paragraphs + plain))


def extraction_quality(checked: DataFrame, text_col: str = "text", source_type: str = "unknown") -> DataFrame:
    """Adds extraction issues, structure score and extraction score to the result of ``basic_quality``.

    For a text that isn't valid the scores are null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(artifact_issues(text), _issues((has_encoding_issues(text), "encoding_issues")))
    if source_type in ("pdf", "image"):
        found = F.concat(found, ocr_issues(text))
    failed = F.array(F.lit("failed_basic_quality"))
    checked = checked.withColumns(
        {
            "extraction_issues": F.when(F.col("valid"), found).otherwise(failed),
            "structure_score": F.when(F.col("valid"), structure_score(text)),
        }
    )
    score = F.col("score") * ((100 - F.size("extraction_issues") * 15) / 100) * F.col("structure_score")
    checked = checked.withColumn("extraction_score", F.when(F.col("valid"), F.greatest(F.lit(0.0), score)))
    valid = (F.col("extraction_score") > 0.6) & (F.size("extraction_issues") < 3)
    return checked.withColumn("extraction_valid", F.when(F.col("valid"), valid))


def vocabulary_diversity(found: Column) -> Column:
    """Distinct words by words, or by their root over a hundred words."""
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    return F.when(n == 0, 0.0).when(n > 100, distinct / F.sqrt(n)).otherwise(distinct / n)


def sentence_complexity(found: Column) -> Column:
    """The mean of words and half of the marks of an array of sentences, by 30, at most 1."""
    marks = lambda s: F.length(s) - F.length(F.translate(s, ",:;()[]{}", ""))
    each = F.transform(found, lambda s: F.size(bare_words(s)) + marks(s) * 0.5)
    return F.coalesce(F.least(F.lit(1.0), mean(each) / 30.0), F.lit(0.0))


def top_count(found: Column) -> Column:
    """How often the most frequent element of an array occurs; by sorting, so that no pair is compared."""
    zero = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s: Column, w: Column) -> Column:
        n = F.when(s["word"] == w, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("word"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

    return F.aggregate(F.sort_array(found), zero, step, lambda s: s["best"])


def repetition_score(found: Column) -> Column:
    n = F.size(found)
    return F.when(n < 10, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (top_count(found) / n - 0.1)))


def french_ratios(text: Column, found: Column) -> tuple[Column, Column]:
    """Stop words by words, accented letters by letters."""
    stops = F.size(F.filter(found, lambda w: w.isin(lx.FRENCH_STOP_QUALITY)))
    accents = ratio(count(text, f"[{lx.ACCENTED_LOWER}]"), count(text, r"\p{L}"))
    some = F.size(found) > 0
    return F.when(some, stops / F.size(found)).otherwise(0.0), F.when(some, accents).otherwise(0.0)


def arabic_ratios(text: Column, found: Column) -> tuple[Column, Column]:
    """Stop words by words, diacritics by Arabic letters."""
    stops = F.size(F.filter(found, lambda w: w.isin(lx.ARABIC_STOP_QUALITY)))
    marks = ratio(count(text, "[ً-ٰٟ]"), count(text, r"[؀-ۿ]"))
    some = F.size(found) > 0
    return F.when(some, stops / F.size(found)).otherwise(0.0), F.when(some, marks).otherwise(0.0)


def _band(value: Column) -> Column:
    """In tenths."""
    return F.when(value.between(0.3, 0.7), 1).when((value < 0.2) | (value > 0.8), -1).otherwise(0)


def readability(docs: DataFrame, text_col: str = "text", language: str = "auto") -> DataFrame:
    """``docs`` with the readability metrics and score; ``auto`` takes the language from the script."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns(
        {
            "language": simple_language(text) if language == "auto" else F.lit(language),
            "_lower": bare_words(F.lower(text)),
            "_plain": bare_words(text),
            "_sentences_r": sentences(text),
        }
    )
    french, arabic = french_ratios(text, F.col("_lower")), arabic_ratios(text, F.col("_plain"))
    is_french, is_arabic = F.col("language") == "french", F.col("language") == "arabic"
    docs = docs.withColumns(
        {
            "vocabulary_diversity": vocabulary_diversity(F.col("_lower")),
            "sentence_complexity": sentence_complexity(F.col("_sentences_r")),
            "repetition_score": repetition_score(F.col("_lower")),
            "french_stop_word_ratio": F.when(is_french, french[0]),
            "french_accent_ratio": F.when(is_french, french[1]),
            "arabic_stop_word_ratio": F.when(is_arabic, arabic[0]),
            "arabic_diacritic_ratio": F.when(is_arabic, arabic[1]),
        }
    )
    score = (
        (7 + _band(F.col("vocabulary_diversity")) + _band(F.col("sentence_complexity"))) / 10
        + (F.col("repetition_score") - 0.5) * 0.2
        + F.when(F.col("french_stop_word_ratio") > 0.15, 0.1).otherwise(0.0)
        + F.when(F.col("french_accent_ratio") > 0.02, 0.05).otherwise(0.0)
        + F.when(F.col("arabic_stop_word_ratio") > 0.15, 0.1).otherwise(0.0)
    )
    docs = docs.withColumn("readability_score", clamp(score)).withColumn("readable", F.col("readability_score") > 0.6)
    return docs.drop("_lower", "_plain", "_sentences_r")


def rating(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").when(score.isNotNull(), "poor")


def recommendations(issues: Column, score: Column) -> Column:
    """Fixed advice, by issue and by score."""
    has = lambda *names: F.arrays_overlap(issues, F.array(*map(F.lit, names)))
    rules = (
        (score < 0.4, "Text quality is poor. Consider re-extracting from source or using a different extraction method."),
        (has("text_too_short"), "Text is too short for reliable analysis. Ensure complete extraction."),
        (has("encoding_issues"), "Encoding issues detected. Check source encoding and extraction settings."),
        (has("excessive_whitespace", "formatting_artifacts"), "Clean up formatting artifacts and excessive whitespace."),
        (has("broken_words"), "Text appears to have broken words. Consider OCR post-processing or manual review."),
        (
            has("character_confusion", "rn_m_confusion"),
            "OCR character confusion detected. Manual review recommended for critical content.",
        ),
        (
            has("low_alphabetic_content"),
            "Text has low alphabetic content. May contain too much formatting or special characters.",
        ),
        (score > 0.7, "Text quality is good and suitable for all processing tasks."),
        ((score > 0.5) & (score <= 0.7), "Text quality is adequate for most processing tasks."),
        (score <= 0.5, "Text quality is marginal. Proceed with caution for important applications."),
    )
    return F.array_compact(F.array(*[F.when(test, advice) for test, advice in rules]))


def suggestions(issues: Column) -> Column:
    rules = {
        "excessive_whitespace": "Remove excessive whitespace using regex: re.sub(r'\\s+', ' ', text)",
        "broken_words": "Consider post-processing to rejoin broken words",
        "encoding_issues": "Re-extract with proper encoding (UTF-8) or use encoding detection",
        "header_footer_artifacts": "Remove headers/footers using pattern matching",
        "character_confusion": "Apply OCR post-correction using character substitution rules",
    }
    return F.array_compact(F.array(*[F.when(F.array_contains(issues, name), text) for name, text in rules.items()]))


def comprehensive(docs: DataFrame, text_col: str = "text", source_type: str = "unknown", language: str = "auto") -> DataFrame:
    """All checks, the overall score to six places and its gates. A text that isn't valid has no score and the status ``error``."""
    checked = extraction_quality(basic_quality(docs, text_col), text_col, source_type)
    checked = readability(checked.drop("language") if "language" in docs.columns else checked, text_col, language)
    overall = F.col("score") * 0.4 + F.col("extraction_score") * 0.3 + F.col("readability_score") * 0.3
    checked = checked.withColumn("overall_score", rounded(overall)).withColumn("all_issues", F.sort_array(F.array_distinct(F.concat("issues", "extraction_issues"))))
    score = F.col("overall_score")
    return checked.withColumns(
        {
            "rating": rating(score),
            "usable": score > 0.4,
            "recommended_for_summarization": score > 0.5,
            "recommended_for_chat": score > 0.6,
            "recommendations": F.when(score.isNotNull(), recommendations(F.col("all_issues"), score)),
            "processing_status": F.when(score.isNull(), "error").otherwise("success"),
        }
    ).drop("_text", "_words", "_sentences")


def pdf_issues(text: Column) -> Column:
    links = (F.length(text) - F.length(F.replace(text, F.lit("http"), F.lit("")))) / 4
    return _issues(
        (text.rlike(rx(r"\w[A-Z][a-z]+[A-Z]")), "column_merge_issues"),
        (text.rlike(rx(r"\b[A-Z]{3,}\b.*\b[A-Z]{3,}\b")), "font_size_artifacts"),
        (links > F.size(words(text)) * 0.05, "excessive_hyperlinks"),
    )


def ocr_confidence(text: Column) -> Column:
    """One less suspicious patterns by words, at least 0."""
    odd = sum((count(text, p) for p in (r"\b\w\b", r"[Il1|]{2,}", r"[^\w\s\.,!?؟،؛]")), F.lit(0))
    n = F.size(bare_words(text))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - odd / n))


# --- scores of the metadata --------------------------------------------------------------------------------


def metadata_quality(text: Column) -> Column:
    """Mean of length, structure, complete sentences and one less the share of words in two scripts."""
    complete = F.size(F.filter(F.split(text, "[.!?؟۔]"), lambda s: F.length(strip(s)) > 10))
    found = words(text)
    mixed = F.size(F.filter(found, lambda w: w.rlike("[a-zA-Z]") & w.rlike("[؀-ۿ]")))
    factors = (
        F.least(F.length(text) / 10000, F.lit(1.0))
        + F.when(text.rlike(rx(r"chapitre|section|article|\n\n", True)), 1.0).otherwise(0.5)
        + F.least(complete / 10, F.lit(1.0))
    )
    n = F.size(found)
    return F.when(text == "", 0.0).when(n == 0, factors / 3).otherwise((factors + 1 - mixed / n) / 4)


def metadata_readability(text: Column) -> Column:
    """One less penalties for sentences over 20 words and words over 6 letters."""
    found, n = words(text), F.size(sentences_metadata(text))
    length = mean(F.transform(found, lambda w: F.length(w).cast("double")))
    long_sentences = F.greatest(F.lit(0.0), (F.size(found) / n - 20) / 30)
    long_words = F.greatest(F.lit(0.0), (length - 6) / 4)
    score = F.greatest(F.lit(0.0), 1.0 - long_sentences - long_words)
    return F.when((n == 0) | (F.size(found) == 0), 0.0).otherwise(score)


def metadata_confidence(chars: Column, doc_type: Column, language: Column, sections: Column, title: Column) -> Column:
    length = F.when(chars > 1000, 1.0).when(chars > 100, 0.7).otherwise(0.3)
    parts = (
        F.when(doc_type != "unknown", 0.8).otherwise(0.3),
        F.when(language != "unknown", 0.9).otherwise(0.4),
        F.when(sections > 0, 0.9).otherwise(0.6),
        F.when(title != "", 0.8).otherwise(0.5),
    )
    return sum(parts, length) / 5


# --- the served checks -------------------------------------------------------------------------------------


def served_quality(text: Column) -> dict[str, Column]:
    found = words(text)
    n, dots = F.size(found), F.size(sentences_by_dot(text))
    length = F.coalesce(mean(F.transform(found, lambda w: F.length(w).cast("double"))), F.lit(0.0))
    return {
        "readability_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - length * 5)),
        "complexity": F.when(length < 5, "simple").when(length < 7, "medium").otherwise("complex"),
        "word_count": n,
        "quality_rating": F.when((n > 100) & (dots > 5), "good").otherwise("fair"),
    }


def served_structure(text: Column) -> dict[str, Column]:
    n, dots = F.size(words(text)), F.size(sentences_by_dot(text))
    blocks = F.size(F.filter(F.split(text, r"\n\n"), lambda p: strip(p) != ""))
    minutes = F.greatest(F.lit(1), F.bround(n / 200).cast("int"))
    return {
        "word_count": n,
        "sentence_count": dots,
        "paragraph_count": blocks,
        "avg_sentence_length": F.coalesce(F.bround(F.try_divide(n, dots), 2), F.lit(0.0)),
        "has_title": strip(text) != "",
        "has_paragraphs": blocks > 1,
        "estimated_reading_time": F.concat(minutes.cast("string"), F.lit(" minutes")),
    }


# --- the cleaner's own assessment ----------------------------------------------------------------------------


def cleaner_quality(text: Column, well_formed_ratio: Column, consistency: Column | None = None) -> dict[str, Column]:
    """Length, diversity, well-formed sentences, consistency where given, and noise; and their mean's level."""
    n_chars, n_words = F.length(text), F.size(words(text))
    chars = F.size(F.array_distinct(F.filter(F.split(F.lower(text), ""), lambda c: c != "")))
    noise = (
        count(text, r"[^\w\s؀-ۿ.!?،؛؟'\"()-]") + count(text, r"\b\w{1}\b") + count(text, r"\b\w*(.)\1{3,}\w*\b")
    )
    noise_ratio = F.when(n_words > 0, noise / n_words).otherwise(1.0)
    factors = [
        F.when(n_chars.between(100, 10000), 1.0).when(n_chars < 100, 0.3).otherwise(0.8),
        F.least(F.coalesce(F.try_divide(chars, n_chars), F.lit(0.0)) * 2, F.lit(1.0)),
        well_formed_ratio,
        F.greatest(F.lit(0.0), 1.0 - noise_ratio * 5),
    ] + ([consistency] if consistency is not None else [])
    score = sum(factors[1:], factors[0]) / len(factors)
    level = F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("very_low")
    return {"noise_ratio": noise_ratio, "overall_quality": F.bround(score, 3), "quality_level": level}
