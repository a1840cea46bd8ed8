"""Language identification by script, common words and patterns, in its several served and library variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions.text import bare_words, count, once, strip

ARABIC = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
LATIN_EXTENDED = "A-Za-zÀ-ſ"


def vote(text: Column) -> Column:
    """``fr`` if more than two of twelve French words occur as substrings, else ``en``."""
    lower = F.lower(text)
    hits = sum((F.contains(lower, F.lit(w)).cast("int") for w in lx.VOTE_WORDS), F.lit(0))
    return F.when(hits > 2, "fr").otherwise("en")


def french_or_arabic(text: Column) -> Column:
    """``fr``, ``ar``, ``mixed`` by the share of Arabic letters, ``unknown`` without letters."""
    arabic, latin = count(text, r"[؀-ۿ]"), count(text, f"[{lx.LATIN_FR}]")
    share = F.try_divide(arabic, arabic + latin)
    return F.when(share.isNull(), "unknown").when(share > 0.6, "ar").when(share < 0.2, "fr").otherwise("mixed")


def script_counts(text: Column) -> dict[str, Column]:
    return {
        "latin": count(text, f"[{LATIN_EXTENDED}]"),
        "arabic": count(text, f"[{ARABIC}]"),
        "other": count(text, rf"[\p{{L}}&&[^{LATIN_EXTENDED}{ARABIC}]]"),
    }


def _shares(counts: dict[str, Column]) -> dict[str, Column]:
    """Each count by the sum of all, null if that is 0; the counts are computed once."""
    def divided(c: Column) -> Column:
        total = sum((c[name] for name in counts), F.lit(0))
        return F.struct(*[F.try_divide(c[name], total).alias(name) for name in counts])

    found = once(F.struct(*[c.alias(name) for name, c in counts.items()]), divided)
    return {name: found[name] for name in counts}


def script_shares(text: Column) -> dict[str, Column]:
    """Shares of Latin, Arabic and other letters; null without any."""
    return _shares(script_counts(text))


def word_shares(text: Column) -> dict[str, Column]:
    """Shares of French and Arabic among the common words met; null without any."""

    def divided(found: Column) -> Column:
        size = lambda listed: F.size(F.filter(found, lambda w: w.isin(listed)))
        counts = F.struct(size(lx.FRENCH_COMMON).alias("french"), size(lx.ARABIC_COMMON).alias("arabic"))
        return once(
            counts,
            lambda c: F.struct(*[F.try_divide(c[x], c["french"] + c["arabic"]).alias(x) for x in ("french", "arabic")]),
        )

    shares = once(bare_words(F.lower(text), lx.DETECTOR_PUNCTUATION), divided)
    return {name: shares[name] for name in ("french", "arabic")}


def pattern_shares(text: Column) -> dict[str, Column]:
    """Shares of French and Arabic pattern matches; null without any."""
    french = sum((count(text, p, True) for p in lx.FRENCH_PATTERNS), F.lit(0))
    arabic_patterns = (f"[{ARABIC}]", f"[{lx.ARABIC_LETTERS}]", f"[{lx.ARABIC_HAMZA}]", "[ً-ٰٟـ]")
    arabic = sum((count(text, p) for p in arabic_patterns), F.lit(0))
    return _shares({"french": french, "arabic": arabic})


def detect(script: dict, word: dict, pattern: dict, n_words: Column, blank: Column, least: float = 0.3) -> Column:
    """Struct of language and confidence from the three kinds of shares.

    Script alone decides texts of fewer than three words where it is clear.
    """

    def score(name: str, of_script: str) -> Column:
        zero = F.lit(0.0)
        return (
            F.coalesce(script[of_script] * 0.3, zero)
            + F.coalesce(word[name] * 0.5, zero)
            + F.coalesce(pattern[name] * 0.2, zero)
        )

    french, arabic = score("french", "latin"), score("arabic", "arabic")
    best = F.greatest(french, arabic)
    name = F.when(french >= arabic, "french").otherwise("arabic")

    def answer(language, confidence) -> Column:
        return F.struct(language.alias("language"), confidence.cast("double").alias("confidence"))

    unknown = answer(F.lit("unknown"), F.lit(0.0))
    short = n_words < 3
    return (
        F.when(blank, unknown)
        .when(short & (script["arabic"] > 0.6), answer(F.lit("arabic"), script["arabic"]))
        .when(short & (script["latin"] > 0.6), answer(F.lit("french"), script["latin"]))
        .when(best < least, unknown)
        .otherwise(answer(name, best))
    )


def detect_language(text: Column, least: float = 0.3) -> Column:
    """Struct of language and confidence, by script, words and patterns together."""
    n = F.size(bare_words(text, lx.DETECTOR_PUNCTUATION))
    return detect(script_shares(text), word_shares(text), pattern_shares(text), n, strip(text) == "", least)


def is_mixed(text: Column, threshold: float = 0.3) -> Column:
    """Whether two of the scripts have more than ``threshold`` of the letters each."""
    hits = sum((F.coalesce((s > threshold).cast("int"), F.lit(0)) for s in script_shares(text).values()), F.lit(0))
    return hits >= 2


def _letters(text: Column) -> Column:
    """Struct of Arabic, accented and plain Latin letters and of all visible characters."""
    return F.struct(
        count(text, f"[{ARABIC}]").alias("arabic"),
        count(text, f"[{lx.ACCENTED_FR}]").alias("accented"),
        count(text, "[a-zA-Z]").alias("latin"),
        count(text, r"\S").alias("total"),
    )


def section_language(text: Column, latin_only: bool = False) -> Column:
    """``arabic``, ``french``, ``mixed`` or ``unknown`` by shares of all visible characters.

    ``latin_only``: unaccented letters alone must reach the share that makes a text French, as for pages.
    """

    def named(c: Column) -> Column:
        total = c["total"]
        french = F.try_divide(c["accented"] + c["latin"], total)
        clear = F.try_divide(c["latin"], total) if latin_only else french
        return (
            F.when(total == 0, "unknown")
            .when((F.try_divide(c["arabic"], total) > 0.1) & (french > 0.1), "mixed")
            .when(F.try_divide(c["arabic"], total) > 0.1, "arabic")
            .when((c["accented"] > 0) | (clear > 0.7), "french")
            .otherwise("unknown")
        )

    return once(_letters(text), named)


def content_languages(text: Column) -> dict[str, Column]:
    """The primary language, an array of secondary ones, and the shares."""

    def named(c: Column) -> Column:
        arabic, french = F.try_divide(c["arabic"], c["total"]), F.try_divide(c["accented"] + c["latin"], c["total"])
        primary = (
            F.when(c["total"] == 0, "unknown")
            .when(arabic > 0.3, "arabic")
            .when((c["accented"] > 0) | (french > 0.7), "french")
            .otherwise("unknown")
        )
        secondary = F.array_compact(
            F.array(
                F.when((primary != "arabic") & (arabic > 0.1), "arabic"), F.when((primary != "french") & (french > 0.1), "french")
            )
        )
        return F.struct(
            primary.alias("primary_language"),
            secondary.alias("secondary_languages"),
            arabic.alias("arabic_ratio"),
            french.alias("french_ratio"),
            (1 - arabic - french).alias("other_ratio"),
        )

    found = once(_letters(text), named)
    names = ("primary_language", "secondary_languages", "arabic_ratio", "french_ratio", "other_ratio")
    return {name: found[name] for name in names}


def simple_language(text: Column) -> Column:
    """``arabic`` if its letters are more than the unaccented Latin ones, ``french`` if there are any of those."""
    arabic, latin = count(text, r"[؀-ۿ]"), count(text, "[A-Za-z]")
    return F.when(arabic > latin, "arabic").when(latin > 0, "french").otherwise("unknown")


def ocr_language(french_text: Column, arabic_text: Column) -> Column:
    """The language of an image by which of two readings has more of its letters."""
    french, arabic = count(french_text, "[a-zA-ZÀ-ÿ]"), count(arabic_text, r"[؀-ۿ]")
    return F.when(arabic > french, "arabic").when(french > arabic, "french").otherwise("mixed")


def consistency(text: Column, language: str) -> Column:
    """The share of a language's letters; .5 for others."""
    if language == "french":
        return F.when(count(text, f"[a-zA-Z{lx.ACCENTED_FR}]") > 0, 1.0).otherwise(0.0)
    if language == "arabic":
        return F.coalesce(F.try_divide(count(text, r"[؀-ۿ]"), count(text, r"\S")), F.lit(0.0))
    return F.lit(0.5)


def text_stats(text: Column) -> dict[str, Column]:
    return {
        "total_chars": F.length(text),
        "alpha_chars": count(text, r"\p{L}"),
        "words": F.size(bare_words(text, lx.DETECTOR_PUNCTUATION)),
        "sentences": F.size(F.split(text, "[.!?؟]")),
        "arabic_chars": count(text, r"[؀-ۿ]"),
        "latin_chars": count(text, "[A-Za-z]"),
        "accented_chars": count(text, f"[{lx.ACCENTED_LOWER}]"),
    }
