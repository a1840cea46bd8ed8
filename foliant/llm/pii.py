"""Sanitisation of personal data: base detectors, and terms that give protected entities away.

The base detectors find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts. Protected entities are the
values found, what such a value is known by in part (the local part and the domain of an address, the first three numbers of an IP
address, the first seven digits of a phone number), and the concepts of ``PROTECTED``, words such as token that announce a value of
no base kind. The information-theoretic step then asks which terms reveal one: for an entity e and a term t, with document
frequencies over the whole corpus, the information that t gives about e is PMI(e; t) = log(p(e, t) / (p(e) p(t))), at most the
information content IC(e) = -log p(e), which it reaches if t never occurs without e. Terms whose PMI is ``DISCLOSURE`` of IC(e) or
more, together with e in ``SUPPORT`` different texts, are over the disclosure threshold. They are sanitised like e itself,
generalised to a tag, wherever they stand in a document that holds e. In a document that doesn't, a disclosing term is tagged if more
than half of the documents with the term hold e, for then a reader who meets it alone infers e; others, rare words of a few copies
that hold e for instance, stay there.

A term is a word, or the shape of one: account numbers, keys and the like seldom recur, so words of ``SHAPE_LEAST`` characters or more
that hold a digit also count as a term that says which characters they are made of and how many. All terms are tried against values
and their parts; against concepts only shapes, as what a concept protects is a value, not the prose around it.

All frequencies count rows of the table, and a term and an entity are together if one text holds both, however far apart. Words
are runs of letters, marks and digits of any length outside base spans, lower-cased. Equal texts count once towards the
support, else a copied document would seem to prove that its own words reveal what it holds; texts that differ at all are
different. An entity in fewer texts than ``SUPPORT`` can't have such a term, so only the others meet terms. Hashes of texts,
entities, terms and counts are shuffled; texts are not, but for more than ``BROADCAST_ROWS`` texts with terms.

Offsets come from the detectors' own matches: a text split at its matches gives the gaps between them, and running sums of
gaps and matches give the code points at which each starts. Running sums, and the cutting of a text at its spans, go in chunks of
``CHUNK``, so that the work on a text with very many spans is near linear. Patterns are written so that no run of characters is tried
from each of its positions, and without nested backtracking, which leaves their matches as they are.

Cases: a null text counts as empty: no spans, and the digest of the empty string. Rows that repeat an id or a text are
judged by their text alone, all alike. Spans of different kinds may overlap; the sanitised text replaces the first and cuts
the rest of an overlap. Ties in the order of spans go by kind as listed. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, hex_sha256, let, materialise

KINDS = ("email", "ip", "card", "phone", "term")

#: What the kinds match. Fixed values; see the docstring for look-behinds and possessive repeats.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

SUPPORT = 3
DISCLOSURE = 0.8
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Words that announce a protected value.
PROTECTED = ("password", "passwd", "pwd", "secret", "token", "apikey", "passport", "ssn", "iban")
#: The least length of a word that counts by its shape too.
SHAPE_LEAST = 12
#: Lists up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 100_000
#: The same for rows that hold lists of terms.
BROADCAST_LISTS = 10_000
#: Words that more than one in so many documents hold are joined apart from the rest.
COMMON = 1000
#: Spans that are folded, and that a text is cut at, at once.
CHUNK = 64
CUT = 512

SPAN = "struct<start: int, rank: int, end: int>"
MATCH = "struct<start: int, rank: int, end: int, value: string>"


def _running(items: Column, step: Callable, out: Callable, kind: str) -> Column:
    """For each of ``items`` what ``out(before, after, item)`` gives for the numbers that ``step(before, item)`` folds, from 0 on.

    A fold copies what it carries at each step. So a first one carries only the number with which each chunk starts, and then each
    chunk is folded by itself; an array in the making is never longer than a chunk.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        after = step(s["state"], x)
        return F.struct(after.alias("state"), F.array_append(s["out"], out(s["state"], after, x)).alias("out"))

    def folded(held: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(held, c * CHUNK + 1, F.lit(CHUNK))

        def through(s: Column, c: Column) -> Column:
            state = F.aggregate(part(c), s["state"], step)
            return F.struct(state.alias("state"), F.array_append(s["starts"], s["state"]).alias("starts"))

        def of_chunk(starts: Column, c: Column) -> Column:
            begin = F.struct(F.get(starts, c).alias("state"), none.alias("out"))
            return F.aggregate(part(c), begin, one, lambda s: s["out"])

        zero = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(chunks, zero, through, lambda s: s["starts"])
        whole = let(starts, lambda at: F.flatten(F.transform(chunks, lambda c: of_chunk(at, c))))
        return F.when(F.size(held) == 0, none).otherwise(whole)

    return let(items, folded)


def _placed(text: Column, pattern: str, made: Callable, kind: str) -> Column:
    """``made(start, end, value)`` of the matches of ``pattern``, in order."""

    def pairs(found: Column, gaps: Column) -> Column:
        return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap")))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(f"array<{kind}>")).otherwise(
            _running(
                pairs(found, F.split(text, pattern, -1)),
                lambda at, x: at + x["gap"] + F.length(x["value"]),
                lambda before, after, x: made(before + x["gap"], after, x["value"]),
                kind,
            )
        ),
    )


def _positions(text: Column, pattern: str, rank: int) -> Column:
    """Structs (start, rank, end, value) of the matches of ``pattern``, in order."""

    def match(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value.alias("value"))

    return _placed(text, pattern, match, MATCH)


def _replaced(text: Column, spans: Column, by: Callable) -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``by(span)``; of one that overlaps others, what they leave of it.

    ``by`` sees the clipped start and end, the rank, and whether the span is ``whole``, so not clipped.
    """
    kind = "struct<start: int, end: int, rank: int, whole: boolean>"

    def clip(reach: Column, after: Column, x: Column) -> Column:
        whole = x["start"] >= reach
        return F.struct(F.greatest(reach, x["start"]).alias("start"), after.alias("end"), x["rank"].alias("rank"), whole.alias("whole"))

    clipped = _running(spans, lambda reach, x: F.greatest(reach, x["end"]), clip, kind)

    def chunk(held: Column, c: Column) -> Column:
        low = F.coalesce(F.get(held, c * CUT - 1)["end"], F.lit(0))

        def cut(low: Column, part: Column, local: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                before = F.coalesce(F.get(part, i - 1)["end"], low)
                return F.concat(F.substring(local, before - low + 1, x["start"] - before), by(x))

            return F.array_join(F.transform(part, piece), "")

        def from_low(low: Column) -> Column:
            return let(
                F.slice(held, c * CUT + 1, F.lit(CUT)),
                lambda part: let(
                    F.substring(text, low + 1, F.element_at(part, -1)["end"] - low), lambda local: cut(low, part, local)
                ),
            )

        return let(low, from_low)

    def whole(held: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CUT).cast("int"))
        rest = F.substring(text, F.element_at(held, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(chunks, lambda c: chunk(held, c)), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(clipped, whole))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, F.lit(9)).otherwise(F.lit(0))
    step = lambda acc, i: acc + F.when(i % 2 == 0, doubled(i)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return let(_digits(value), _luhn)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the array of its spans; cheap tests spare most texts the patterns."""
    maybe = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][ -]?){13}[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }
    empty = F.array().cast(f"array<{MATCH}>")

    def spans(rank: int, kind: str) -> Column:
        found = F.filter(_positions(text, PATTERNS[kind], rank), lambda s: _valid(kind, s["value"]))
        return F.when(maybe[kind], found).otherwise(empty)

    return {kind: spans(rank, kind) for rank, kind in enumerate(KINDS[:4])}


def _kind(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), rank)


def _blanked(text: Column, base: Column) -> Column:
    """``text`` with blanks for the characters of base spans; offsets stay."""
    return _replaced(text, base, lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))


def _shape(word: Column) -> Column:
    """A term for words of the same length and characters; the sign before it is in no word. Null for most words."""
    made_of = F.when(word.rlike("^[0-9]+$"), F.lit("#digits")).when(word.rlike("^[0-9a-f]+$"), F.lit("#hex")).otherwise(F.lit("#mixed"))
    return F.when((F.length(word) >= SHAPE_LEAST) & word.rlike("[0-9]"), F.concat(made_of, F.length(word)))


def _terms() -> Column:
    """The different terms of a text outside its base spans, of rows of ``_found``."""
    words = F.regexp_extract_all(_blanked(F.col("text"), F.col("base")), F.lit(WORD), F.lit(0))
    lower = lambda w: F.array_distinct(F.transform(w, F.lower))
    shapes = lambda w: F.array_distinct(F.filter(F.transform(w, _shape), lambda x: x.isNotNull()))
    return let(lower(words), lambda w: F.concat(w, shapes(w)))


def _entities() -> Column:
    """The different protected entities of a text, of rows of ``_found``."""
    value = lambda s: F.lower(s["value"])
    of_rank = lambda k: F.filter("base", lambda s: s["rank"] == k)
    values = F.transform("base", lambda s: F.concat_ws(":", _kind(s["rank"]), value(s)))
    parts = [
        F.transform(of_rank(0), lambda s: F.concat(F.lit("local:"), F.substring_index(value(s), "@", 1))),
        F.transform(of_rank(0), lambda s: F.concat(F.lit("domain:"), F.substring_index(value(s), "@", -1))),
        F.transform(of_rank(1), lambda s: F.concat(F.lit("net:"), F.substring_index(value(s), ".", 3))),
        F.transform(of_rank(3), lambda s: F.concat(F.lit("exchange:"), F.substring(_digits(value(s)), F.lit(1), F.lit(7)))),
    ]
    named = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(PROTECTED)})(?![\p{{L}}\p{{M}}\p{{N}}])"
    concepts = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(named), F.lit(0)), lambda w: F.concat(F.lit("about:"), w))
    none = F.array().cast("array<string>")
    of_base = F.when(F.size("base") > 0, F.concat(values, *parts)).otherwise(none)
    return F.array_distinct(F.concat(of_base, concepts))


def _tried(entity: Column, terms: Column) -> Column:
    """The terms that are tried against an entity."""
    return F.when(entity.startswith("about:"), F.filter(terms, lambda t: t.startswith("#"))).otherwise(terms)


def _found(texts: DataFrame) -> DataFrame:
    """doc_id, text, the counts by base kind, and all base spans in order."""
    merged = F.array_sort(F.concat("email", "ip", "card", "phone"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    return texts.withColumns(base_spans(F.col("text"))).select("doc_id", "text", *counts, merged.alias("base"))


def _holders(found: DataFrame) -> DataFrame:
    """(key, entities, terms) of the texts with protected entities."""
    held = found.select("text", "base", _entities().alias("entities")).where(F.size("entities") > 0)
    return held.select(F.xxhash64("text").alias("key"), "entities", _terms().alias("terms"))


def disclosing_terms(found: DataFrame, holders: DataFrame) -> DataFrame:
    """(entity, term, n_both, n_term, pmi, ic) of the pairs over the disclosure threshold."""
    of_entity = materialise(
        holders.select("key", F.explode("entities").alias("entity"))
        .groupBy("entity", "key")
        .agg(F.count("*").alias("rows"))
        .groupBy("entity")
        .agg(F.sum("rows").alias("n_entity"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT)
        .select("entity", "n_entity"),
        "pii-entities",
    )
    together = materialise(
        holders.select("key", "terms", F.explode("entities").alias("entity"))
        .join(bounded(of_entity.select("entity"), BROADCAST_ROWS), "entity")
        .select("key", "entity", F.explode(_tried(F.col("entity"), F.col("terms"))).alias("term"))
        .groupBy("entity", "term", "key")
        .agg(F.count("*").alias("rows"))
        .groupBy("entity", "term")
        .agg(F.sum("rows").alias("n_both"), F.count("*").alias("texts"))
        .where(F.col("texts") >= SUPPORT),
        "pii-pairs",
    )
    # Outer explodes of terms of texts: for inner ones Spark would find all terms once more, in a filter on their number.
    of_term = materialise(
        found.select(F.explode_outer(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= SUPPORT),
        "pii-counts",
    )
    total = max(found.count(), 1)
    # A common term has a pair with most entities. There are few such terms, so they needn't bring all those pairs into one task.
    common = F.col("n_term") > F.lit(total / COMMON)
    often = bounded(of_term.where(common), BROADCAST_ROWS)
    rare = together.join(often.select("term"), "term", "left_anti").join(of_term.where(~common), "term")
    counted = together.join(often, "term").unionByName(rare)
    pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    ic = F.log(F.lit(float(total)) / F.col("n_entity"))
    return (
        counted.join(bounded(of_entity, BROADCAST_ROWS), "entity")
        .select("entity", "term", "n_both", "n_term", pmi.alias("pmi"), ic.alias("ic"))
        .where((F.col("ic") > 0) & (F.col("pmi") >= DISCLOSURE * F.col("ic")))
    )


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words of ``text`` that are, or have a shape that is, among ``terms``."""
    none = F.array().cast(f"array<{SPAN}>")

    def span(start: Column, end: Column, value: Column) -> Column:
        word = lambda w: F.array_contains(terms, w) | F.coalesce(F.array_contains(terms, _shape(w)), F.lit(False))
        rank = F.when(let(F.lower(value), word), F.lit(4))
        return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"))

    spans = F.filter(_placed(text, WORD, span, SPAN), lambda s: s["rank"].isNotNull())
    return F.when(F.size(terms) > 0, spans).otherwise(none)


def _sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by the tag of its kind."""
    tag = lambda x: F.concat(F.lit("["), F.upper(_kind(x["rank"])), F.lit("]"))
    return _replaced(text, spans, lambda x: F.when(x["whole"], tag(x)).otherwise(F.lit("")))


def _coded(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["rank"]), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, arrays of base and all spans, counts by kind, and the clean text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _found(texts)
    holders = materialise(_holders(found), "pii-holders")
    disclosing = materialise(disclosing_terms(found, holders), "pii-terms")
    alone = disclosing.where(2 * F.col("n_both") > F.col("n_term")).select("term").distinct()
    every = found.select(F.xxhash64("text").alias("key"), F.explode_outer(_terms()).alias("term"))
    anywhere = every.join(bounded(alone, BROADCAST_ROWS), "term")
    # The terms of a text are sought among those of its own entities: it has no pair for each of its terms then.
    beside = (
        holders.select("key", "terms", F.explode("entities").alias("entity"))
        .join(bounded(disclosing.groupBy("entity").agg(F.collect_set("term").alias("of_entity")), BROADCAST_LISTS), "entity")
        .select("key", F.explode(F.array_intersect("terms", "of_entity")).alias("term"))
    )
    held = materialise(
        anywhere.select("key", "term")
        .unionByName(beside)
        .groupBy("key")
        .agg(F.collect_set("term").alias("held")),
        "pii-held",
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    # Texts whose hashes collide do no harm: the words of one are looked for in the other.
    return (
        found.join(bounded(held, BROADCAST_LISTS), F.xxhash64("text") == F.col("key"), "left")
        .select(
            "doc_id",
            "text",
            *[f"n_{kind}" for kind in KINDS[:4]],
            plain.alias("base"),
            _term_spans(_blanked(F.col("text"), F.col("base")), F.coalesce("held", F.array().cast("array<string>"))).alias("terms"),
        )
        .withColumn("spans", F.array_sort(F.concat("base", "terms")))
        .select(
            "doc_id",
            *[f"n_{kind}" for kind in KINDS[:4]],
            F.size("terms").cast("long").alias("n_term"),
            "base",
            "spans",
            _sanitised(F.col("text"), F.col("spans")).alias("clean_text"),
        )
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, the numbers of method spans and of all spans, and a digest of the clean text."""
    return sanitise(docs).select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS[:4]],
        hex_sha256(_coded(F.col("base"))).alias("base_sha256"),
        _coded(F.col("spans")).alias("spans"),
        "n_term",
        F.size("spans").cast("long").alias("n_spans"),
        hex_sha256(F.col("clean_text")).alias("clean_sha256"),
    )
