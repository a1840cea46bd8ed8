"""Tokenizers and text cleaning as Column expressions.

All of it runs in the JVM; the one step that Spark has no expression for, Unicode normalisation, is an Arrow UDF that
callers may leave out. Regular expressions carry ``(?U)``, so that ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions import lexicons as lx

#: What counts as white space, for trimming and in a character class.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern under the dialect used throughout."""
    return ("(?Ui)" if ignore_case else "(?U)") + pattern


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sub(text: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), replacement)


def count(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, ignore_case)))


def starts(text: Column, patterns, ignore_case: bool = False) -> Column:
    """Whether one of ``patterns`` matches at the start of ``text``."""
    return text.rlike(rx("|".join(rf"\A(?:{p.removeprefix('^')})" for p in patterns), ignore_case))


def count_literal(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded(value: Column) -> Column:
    """A double to six places, as DuckDB rounds it: the millionths are a rounded product, and halves of those go away from zero."""
    return F.round(value * 1e6) / 1e6


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


# --- tokenizers ---------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def bare_words(text: Column, punctuation: str = lx.QUALITY_PUNCTUATION) -> Column:
    """Words after deleting punctuation."""
    return words(F.translate(text, punctuation, ""))


def pieces(text: Column, separator: str) -> Column:
    """Stripped, non-empty pieces of a text."""
    return F.filter(F.transform(F.split(text, separator), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    return pieces(text, r"[.!?؟]+" + BLANK + "*")


def sentences_metadata(text: Column) -> Column:
    return pieces(text, r"[.!?؟۔]+")


def sentences_by_dot(text: Column) -> Column:
    return pieces(text, r"\.")


def sentences_segmented(text: Column) -> Column:
    """Sentences with their terminators; a stand-in for a trained segmenter, by rule.

    A sentence ends at a terminator before white space and an upper-case or Arabic letter, or a line end.
    """
    return pieces(text, r"(?<=[.!?؟])" + BLANK + r"+(?=[\p{Lu}\p{InArabic}\d«\"(])")


def sentences_ocr(text: Column, language: str = "french") -> Column:
    found = pieces(text, r"[.!?؟।]+" if language == "arabic" else r"[.!?]+")
    return F.filter(found, lambda s: F.length(s) > 5)


def paragraphs(text: Column) -> Column:
    return pieces(text, r"\n\n")


def letter_words(text: Column, least: int = 4) -> Column:
    """Words of Latin, accented or Arabic letters, of ``least`` letters or more, lower-cased."""
    found = F.regexp_extract_all(text, F.lit(rx(rf"\b[a-zA-Z{lx.ACCENTED_FR}؀-ۿ]{{{least},}}\b")), F.lit(0))
    return F.transform(found, F.lower)


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def coverage(part: Column, whole: Column) -> Column:
    """The share of ``part`` as a set that is in ``whole``."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(part))).otherwise(0.0)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def drop_redundant(found: Column, threshold: float = 0.8) -> Column:
    """Sentences in order, without those more similar than ``threshold`` to one that was kept.

    Each sentence's words are found once, and its number of words bounds the similarity before any sets are compared.
    """
    held = F.transform(found, lambda s: F.struct(s.alias("s"), word_set(s).alias("w")))

    def close(k: Column, x: Column) -> Column:
        few, many = F.least(F.size(k["w"]), F.size(x["w"])), F.greatest(F.size(k["w"]), F.size(x["w"]))
        return (few > many * threshold) & (jaccard(k["w"], x["w"]) > threshold)

    kept = F.aggregate(
        held,
        F.array().cast("array<struct<s: string, w: array<string>>>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: close(k, x)), kept).otherwise(F.array_append(kept, x)),
    )
    return F.transform(kept, lambda x: x["s"])


# --- cleaning -----------------------------------------------------------------------------------------------


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode normalisation form KC."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def redecode(texts: pa.Array) -> pa.Array:
    """Texts whose UTF-8 was read as Latin-1, read again; those that can't be stay."""

    def again(text):
        try:
            return text.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text

    return pa.array([None if t is None else again(t) for t in texts.to_pylist()], pa.string())


def fix_mojibake(text: Column) -> Column:
    return reduce(lambda t, fix: F.replace(t, F.lit(fix[0]), F.lit(fix[1])), lx.MOJIBAKE, text)


def fix_encoding(text: Column) -> Column:
    """Known broken sequences, then a second reading where the sign of one is left."""
    fixed = fix_mojibake(text)
    return F.when(F.contains(fixed, F.lit("Ã")), redecode(fixed)).otherwise(fixed)


def fold_arabic(text: Column) -> Column:
    """One form of alef, yeh and teh marbuta, no tatweel, and Latin punctuation."""
    return F.translate(text, "إأآىئه،؛؟ـ", "ااايية,;?")


def preprocess(text: Column) -> Column:
    """Single line ends, no carriage returns, stripped."""
    return strip(F.replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), F.lit("\r"), F.lit("")))


def ingest_preview(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def clean_light(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", " ")


def clean_basic(text: Column) -> Column:
    one_line = sub(sub(sub(clean_light(text), r"\|\s*\|", " "), "_{3,}", ""), "-{3,}", "")
    return strip(one_line)


def normalise_final(text: Column) -> Column:
    """Line ends, trailing white space, at most two empty lines in a row, single blanks."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n"), lambda s: F.regexp_replace(s, BLANK + r"+\z", ""))
    joined = F.array_join(lines, "\n")
    # Up to two empty lines stay: at the start two line ends, elsewhere three.
    shorter = F.regexp_replace(F.regexp_replace(joined, r"\A\n{3,}", "\n\n"), r"(?<=[^\n])\n{4,}", "\n\n\n")
    return F.regexp_replace(shorter, r"[ \t]+", " ")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def drop_headers_footers(text: Column) -> Column:
    kept = F.filter(_lines(text), lambda s: (s == "") | ~starts(s, lx.HEADER_FOOTER, True))
    return F.array_join(kept, "\n")


def is_noise(line: Column) -> Column:
    return starts(line, lx.NOISE_LINES)


def fix_ocr(text: Column, language: str = "mixed") -> Column:
    fixed = reduce(lambda t, fix: sub(t, fix[0], fix[1], True), lx.OCR_FIXES, text)
    if language in ("french", "mixed"):
        letter = f"[a-zA-Z{lx.ACCENTED_FR}]"
        fixed = sub(fixed, rf"\b({letter})\s+({letter})\b", "$1$2")
    if language in ("arabic", "mixed"):
        fixed = sub(fixed, r"\b([؀-ۿ])\s+([؀-ۿ])\b", "$1$2")
    return fixed


def clean_line(line: Column) -> Column:
    upper = lx.ACCENTED_FR[len(lx.ACCENTED_FR) // 2 :]
    steps = (
        (r"\s+([.!?;:,])", "$1"),
        (rf"([.!?])\s*([A-Z{upper}؀-ۿ])", "$1 $2"),
        (r"[.]{3,}", "..."),
        (r"[-]{3,}", "---"),
        ("[\"„]", '"'),
        ("['`´]", "'"),
        (r"\s[^\w\s]{1}\s", " "),
        (r"\s+", " "),
    )
    return strip(reduce(lambda t, s: sub(t, *s), steps, line))


def clean_line_hard(line: Column, language: str = "mixed") -> Column:
    line = clean_line(line)
    if language == "french":
        line = sub(line, rf"\b(?![àyAÀY])[a-zA-Z{lx.ACCENTED_FR}]\b", "")
    else:
        line = sub(line, r"\b[a-zA-Z]\b", "")
    if language != "mixed":
        line = sub(sub(line, r"\b\w*[a-zA-Z][؀-ۿ]\w*\b", ""), r"\b\w*[؀-ۿ][a-zA-Z]\w*\b", "")
    return strip(sub(sub(line, r"\b\w*(.)\1{3,}\w*\b", ""), r"\s+", " "))


def clean_standard(text: Column) -> Column:
    """Empty lines stay, noise lines go, the others are cleaned."""
    kept = F.filter(_lines(text), lambda s: (s == "") | ~is_noise(s))
    cleaned = F.transform(kept, lambda s: F.struct((s == "").alias("empty"), clean_line(s).alias("line")))
    return F.array_join(F.transform(F.filter(cleaned, lambda x: x["empty"] | (x["line"] != "")), lambda x: x["line"]), "\n")


def survives(line: Column) -> Column:
    """Whether the hard level keeps a line: five characters or more, no noise, at most half of it marks."""
    marks = F.length(line) - F.length(F.translate(line, lx.PUNCTUATION, ""))
    return (line != "") & ~is_noise(line) & (F.length(line) >= 5) & (marks <= F.length(line) * 0.5)


def clean_aggressive(text: Column, language: str = "mixed") -> Column:
    """Only lines of some length, mostly of letters, survive."""
    cleaned = F.transform(F.filter(_lines(text), survives), lambda s: clean_line_hard(s, language))
    return F.array_join(F.filter(cleaned, lambda s: F.length(s) >= 3), "\n")


def french_share(text: Column) -> Column:
    return count(text, f"[{lx.ACCENTED_FR}a-zA-Z]") / count(text, r"\S")


def looks_french(text: Column) -> Column:
    return F.coalesce(F.try_divide(count(text, f"[{lx.ACCENTED_FR}a-zA-Z]"), count(text, r"\S")) > 0.3, F.lit(False))


def looks_arabic(text: Column) -> Column:
    return F.coalesce(F.try_divide(count(text, r"[؀-ۿ]"), count(text, r"\S")) > 0.1, F.lit(False))


def clean_french(text: Column) -> Column:
    steps = [
        (r"(\w)\s*['`´]\s*(\w)", r"$1'$2"),
        (r"<<\s*", "« "),
        (r"\s*>>", " »"),
        (r"\s*([;:!?])", " $1"),
        (r"([;:!?])\s*", "$1 "),
        (r"\b([A-Z])\.\s*([A-Z])\.\s*([A-Z])", "$1.$2.$3"),
    ]
    text = reduce(lambda t, s: sub(t, *s), steps, text)
    return reduce(lambda t, e: sub(t, rf"\b{e}'\s*", f"{e}'", True), lx.ELISIONS, text)


def clean_arabic(text: Column, drop_diacritics: bool = False) -> Column:
    text = sub(sub(text, r"\s*([،؛؟])", "$1"), r"([،؛؟])\s*", "$1 ")
    arabic = count(text, r"[؀-ۿ]") / F.greatest(F.length(text), F.lit(1))
    text = F.when(arabic > 0.3, F.translate(text, "()", ")(")).otherwise(text)
    text = sub(sub(text, r"(\w)\s+(ال)", "$1$2"), r"(و)\s+(\w)", "$1$2")
    return sub(text, r"[ً-ِْ]", "") if drop_diacritics else text


def clean_text(text: Column, language: str = "mixed", level: str = "standard", normalise: bool = True) -> Column:
    """The whole chain: encoding, normalisation, headers, OCR, the level, the language, the end."""
    cleaned = fix_encoding(text) if normalise else fix_mojibake(text)
    cleaned = nfkc(cleaned) if normalise else cleaned
    cleaned = fold_arabic(cleaned) if language == "arabic" else cleaned
    cleaned = fix_ocr(drop_headers_footers(cleaned), language)
    if level == "light":
        cleaned = clean_light(cleaned)
    elif level == "aggressive":
        cleaned = clean_aggressive(cleaned, language)
    else:
        cleaned = clean_standard(cleaned)
    if language == "french":
        cleaned = clean_french(cleaned)
    elif language == "mixed":
        cleaned = F.when(looks_french(cleaned), clean_french(cleaned)).otherwise(cleaned)
    if language == "arabic":
        cleaned = clean_arabic(cleaned)
    elif language == "mixed":
        cleaned = F.when(looks_arabic(cleaned), clean_arabic(cleaned)).otherwise(cleaned)
    return F.when(strip(text) == "", F.lit("")).otherwise(strip(normalise_final(cleaned)))


def clean_for_summary(cleaned: Column) -> Column:
    """Cleaned text without near-repeated sentences and those of fewer than five words."""
    kept = drop_redundant(sentences_segmented(cleaned), 0.7)
    return F.array_join(F.filter(kept, lambda s: F.size(words(s)) >= 5), " ")


def well_formed(sentence: Column, language: str = "mixed") -> Column:
    """Enough words, a terminator, enough different characters, and enough of the language's letters."""
    chars = F.array_distinct(F.filter(F.split(F.lower(sentence), ""), lambda c: c != ""))
    good = (F.size(words(sentence)) >= 3) & sentence.rlike("[.!?؟]") & (F.size(chars) >= F.length(sentence) * 0.3)
    if language == "arabic":
        good = good & (count(sentence, r"[؀-ۿ]") >= F.length(sentence) * 0.1)
    if language == "french":
        good = good & (count(sentence, f"[a-zA-Z{lx.ACCENTED_FR}]") >= F.length(sentence) * 0.5)
    return good


def clean_sentences(cleaned: Column, language: str = "mixed", least: int = 10, most: int = 500) -> Column:
    return F.filter(
        sentences_segmented(cleaned), lambda s: F.length(s).between(least, most) & well_formed(s, language)
    )


# --- text read from images ------------------------------------------------------------------------------------


def clean_ocr_french(text: Column) -> Column:
    return strip(sub(sub(text, r"[^\w\s؀-ۿÀ-ÿ.,;:!?()\-'\"]+", " "), r"\s+", " "))


def clean_ocr_arabic(text: Column) -> Column:
    folded = sub(F.translate(text, "أإآةى", "اااهي"), r"[ً-ْٰـ]", "")
    return strip(sub(sub(folded, r"[^؀-ۿ\w\s.,;:!?()\-'\"]+", " "), r"\s+", " "))


def normalise_ocr(text: Column, language: str) -> Column:
    if language == "arabic":
        return clean_ocr_arabic(text)
    cleaned = clean_ocr_french(text)
    return cleaned if language == "french" else clean_ocr_arabic(cleaned)


def drop_ocr_noise(text: Column) -> Column:
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s: F.length(strip(s)) > 2), " ")
    return sub(sub(kept, r"\b\w\b", " "), r"(.)\1{3,}", "$1")


def finish_answer(text: Column) -> Column:
    """A generated answer without repeated stretches and trailing fragments, ended by a full stop."""
    tidy = strip(sub(sub(text, r"(.{20,}?)\1+", "$1"), r"\s+", " "))
    parts = F.split(tidy, r"\.", -1)
    short = (F.size(parts) > 1) & (F.length(strip(F.element_at(parts, -1))) < 10)
    cut = F.when(short, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."), F.lit("."))).otherwise(tidy)
    return F.when(cut.rlike(r"[.!?]\z"), cut).otherwise(F.concat(cut, F.lit(".")))
