"""Dates, references, places, persons, organisations and keywords found by pattern.

Sets of matches come as sorted arrays. Where a pattern has a group, the group is the match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.functions.text import letter_words, once, rx, strip


def matches(text: Column, patterns, ignore_case: bool = False) -> Column:
    """All matches, pattern by pattern; each pattern comes with the group to return."""
    found = [F.regexp_extract_all(text, F.lit(rx(p, ignore_case)), F.lit(group)) for p, group in patterns]
    return F.concat(*found)


def _by_language(text: Column, language: Column, french, arabic) -> Column:
    none = F.array().cast("array<string>")
    of_french = F.when(language.isin("fr", "mixed"), matches(text, french, True)).otherwise(none)
    of_arabic = F.when(language.isin("ar", "mixed"), matches(text, arabic)).otherwise(none)
    return F.concat(of_french, of_arabic)


def as_set(found: Column) -> Column:
    return F.sort_array(F.array_distinct(found))


def dates(text: Column, language: Column) -> Column:
    found = F.transform(_by_language(text, language, lx.DATES_FR, lx.DATES_AR), strip)
    return as_set(F.filter(found, lambda d: F.length(d) > 3))


def references(text: Column, language: Column) -> Column:
    return as_set(_by_language(text, language, lx.REFERENCES_FR, lx.REFERENCES_AR))


def places(text: Column, language: Column) -> Column:
    return as_set(_by_language(text, language, lx.PLACES_FR, lx.PLACES_AR))


def _arabic_only(text: Column, language: Column, patterns) -> Column:
    found = matches(text, [(p, 0) for p in patterns])
    return as_set(F.when(language.isin("ar", "mixed"), found).otherwise(F.array().cast("array<string>")))


def persons(text: Column, language: Column) -> Column:
    """Pairs of Arabic words; names in other texts need a model, see ``foliant.operators.models``."""
    return _arabic_only(text, language, lx.PERSONS_AR)


def organisations(text: Column, language: Column) -> Column:
    return _arabic_only(text, language, lx.ORGANISATIONS_AR)


def entity_total(*found: Column) -> Column:
    return sum((F.size(f) for f in found), F.lit(0))


def by_frequency(found: Column) -> Column:
    """Structs (count, word) of an array's words, most frequent first, ties by first occurrence.

    Word by word this would be quadratic; sorting (word, place) pairs brings equal words together instead. Then the
    first pair of each run knows its word's first place, and the next such pair, or the end, the run's length.
    """

    def runs(placed: Column) -> Column:
        n = F.size(placed)
        heads = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(placed, i)["word"] != F.get(placed, i - 1)["word"]),
        )
        return once(heads, lambda held: counted(placed, held, n))

    def counted(placed: Column, heads: Column, n: Column) -> Column:
        ends = F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(n))
        ranked = F.zip_with(
            heads,
            ends,
            lambda a, b: F.struct((a - b).alias("n"), F.get(placed, a)["at"].alias("at"), F.get(placed, a)["word"].alias("word")),
        )
        return F.transform(F.sort_array(ranked), lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word")))

    placed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    none = F.array().cast("array<struct<n: int, word: string>>")
    return once(placed, lambda p: F.when(F.size(p) == 0, none).when(p.isNotNull(), runs(p)))


def keyword_words(text: Column, language: Column) -> Column:
    """The words that count for a document's keywords, Arabic ones first, without stop words.

    Null for a text of no known language: its keywords are an error, not an empty list.
    """
    arabic = F.filter(
        F.regexp_extract_all(text, F.lit("([؀-ۿ]{3,})"), F.lit(1)), lambda w: ~w.isin(lx.ARABIC_STOP_KEYWORDS)
    )
    french = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(rx(r"\b[a-zA-Zàâäéèêëïîôöùûüç]{3,}\b")), F.lit(0)),
        lambda w: ~w.isin(lx.FRENCH_STOP_KEYWORDS),
    )
    return F.when(language == "ar", arabic).when(language == "fr", french).when(language == "mixed", F.concat(arabic, french))


def ranked_keywords(text: Column, language: Column, top: int = 10) -> Column:
    """Structs (count, word) of the most frequent keywords, ties by first occurrence; null for a text of no known language."""
    return F.slice(by_frequency(keyword_words(text, language)), 1, top)


def keywords(text: Column, language: Column, top: int = 10) -> Column:
    return F.transform(ranked_keywords(text, language, top), lambda x: x["word"])


def ranked_section_keywords(text: Column, top: int = 10) -> Column:
    """Of the most frequent ``2 * top`` words those that are no stop words and occur twice, as structs (count, word)."""
    ranked = F.slice(by_frequency(letter_words(text)), 1, 2 * top)
    kept = F.filter(ranked, lambda x: ~x["word"].isin(lx.SECTION_STOP) & (x["n"] >= 2))
    none = F.array().cast("array<struct<n: int, word: string>>")
    return F.when(F.length(text) < 50, none).otherwise(F.slice(kept, 1, top))


def section_keywords(text: Column, top: int = 10) -> Column:
    return F.transform(ranked_section_keywords(text, top), lambda x: x["word"])


def metadata_keywords(text: Column, top: int = 20) -> Column:
    """Transport terms as they occur, repeats included, then frequent words that are not among them."""
    ranked = F.filter(F.slice(by_frequency(letter_words(text)), 1, top), lambda x: x["n"] > 2)
    frequent = F.transform(ranked, lambda x: x["word"])

    def joined(terms: Column) -> Column:
        fresh = F.filter(frequent, lambda w: ~F.array_contains(terms, w))
        return F.slice(F.concat(terms, fresh), 1, top)

    return once(matches(F.lower(text), [(p, 0) for p in lx.TRANSPORT_TERMS]), joined)


def key_terms(text: Column, top: int = 10) -> Column:
    """Distinct words of five characters and more, without marks at their ends, in order of the alphabet."""
    found = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 4)
    return F.slice(as_set(F.transform(found, lambda w: F.lower(F.btrim(w, F.lit(".,!?;:"))))), 1, top)


# --- dates in context -----------------------------------------------------------------------------------------


def parse_date(found: Column, dayfirst: bool = False) -> Column:
    """A date of three numbers, or of day, month name and year. Month first, unless that month is over 12."""
    number = lambda i: F.regexp_extract(found, r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", i)
    a, b, year = number(1), number(2), number(3)
    day_first = (a.try_cast("int") > 12) | (F.lit(dayfirst) & (b.try_cast("int") <= 12))
    month, day = F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)
    numeric = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    names = lx.MONTHS_FR.split("|"), lx.MONTHS_AR_PARSED.split("|")
    named = F.regexp_extract(found, rx(rf"(\d{{1,2}})\s+({lx.MONTHS_FR}|{lx.MONTHS_AR_PARSED})\s+(\d{{4}})", True), 0)
    part = lambda i: F.regexp_extract(named, rx(rf"(\d{{1,2}})\s+({lx.MONTHS_FR}|{lx.MONTHS_AR_PARSED})\s+(\d{{4}})", True), i)
    word = F.lower(part(2))
    place = F.greatest(*[F.array_position(F.array(*map(F.lit, group)), word) for group in names])
    spelled = F.try_to_date(
        F.concat_ws("-", part(3), F.lpad(place.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd"
    )
    return F.coalesce(numeric, spelled)


def typed_dates(text: Column) -> Column:
    """Struct of approval, effective and creation date by the 50 characters on either side.

    Of approval and effective dates the last one counts, of creation dates the first.
    """
    date = rf"\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{4}}|\d{{1,2}}\s+(?:{lx.MONTHS_FR}|{lx.MONTHS_AR_PARSED})\s+\d{{4}}"

    def typed(found: Column, gaps: Column) -> Column:
        def one(d: Column, i: Column) -> Column:
            near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(50)), F.left(F.get(gaps, i + 1), F.lit(50))))
            kind = (
                F.when(near.rlike("|".join(lx.APPROVAL_CONTEXT)), "approval")
                .when(near.rlike("|".join(lx.EFFECTIVE_CONTEXT)), "effective")
                .otherwise("creation")
            )
            return F.struct(kind.alias("kind"), parse_date(d).alias("date"))

        return F.filter(F.transform(found, one), lambda x: x["date"].isNotNull())

    def chosen(dated: Column) -> Column:
        of = lambda name: F.transform(F.filter(dated, lambda x: x["kind"] == name), lambda x: x["date"])
        return F.struct(
            F.try_element_at(of("approval"), F.lit(-1)).alias("approval_date"),
            F.try_element_at(of("effective"), F.lit(-1)).alias("effective_date"),
            F.try_element_at(of("creation"), F.lit(1)).alias("creation_date"),
        )

    none = F.array().cast("array<struct<kind: string, date: date>>")
    dated = once(
        F.regexp_extract_all(text, F.lit(rx(date, True)), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(
            once(F.split(text, rx(date, True), -1), lambda gaps: typed(found, gaps))
        ),
    )
    return once(dated, chosen)
