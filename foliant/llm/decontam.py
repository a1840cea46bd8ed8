"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of word hashes. A fixed mask selects some positions of a window and ignores the others, so two
windows that differ at ignored positions only have the same hash. Masked windows of the benchmark (the test side) and of
the documents (the training side), at every position of each, meet in an equi-join. A hit gives an alignment of an item
and a document; along it the two are compared word by word, and the best segment, where a match scores 1 and a substitution
-2, is the overlap. A document is contaminated by an item if that segment has ``MIN_MATCHES`` matching words, or, for
items so short, ``MIN_SHARE`` of the item's words.

An item of fewer words than a mask is long, ``SPAN``, has no masked window. The hash of its whole word sequence meets the hashes of
the documents' windows of the same length, for each length that such items have, so a document is contaminated by it if it holds it
word for word.

Only alignments are shuffled, combined in each task; documents that have one are read again for their words. A passage in a
third of all documents makes alignments in proportion to its occurrences.

Cases: words are runs of letters and digits, lower-cased, so case, punctuation and white space don't count; in scripts written
without spaces each letter is a word. A null or empty text has no words. A document of fewer words than ``SPAN`` is judged by
short items only. An item of one word contaminates every document with that word.
Texts are judged, not ids: rows that agree in id and text are one document, rows that share an id but not a text, or have none, are
documents of their own, and a clean row never goes for what another row holds. Repeated items each give their rows; items without
id are one item for each text. Without items there are no rows. Other columns are ignored, or carried along by ``drop_leaks``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, fresh_names, let, materialise, text_key

#: The positions of a window that count: three masks of weight 7 and span 11. Of passages of 14 and 30 words with a tenth of
#: the words replaced at random they hit 94 and 100 in a hundred (simulated).
MASKS = ((0, 4, 5, 7, 8, 9, 10), (0, 1, 2, 3, 4, 8, 10), (0, 1, 3, 6, 7, 9, 10))
SPAN = 11
#: Letters of scripts without spaces between words.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
#: All such letters are beyond this one; a plain range is tried much faster than scripts are looked up.
FIRST_UNSPACED = r"[\x{0E00}-\x{10FFFF}]"
MIN_MATCHES = 13
MIN_SHARE = 0.7
#: Seed tables and lists of documents with hits up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_SEEDS = 500_000
BROADCAST_HITS = 1_000_000


def word_hashes(text: Column) -> Column:
    spaced = let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: F.when(t.rlike(FIRST_UNSPACED) & t.rlike(UNSPACED), F.regexp_replace(t, UNSPACED, " $1 ")).otherwise(t),
    )
    words = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masked_windows(hashes: Column) -> Column:
    """The masked hash of each window, all of the first mask, then all of the next."""
    n = F.size(hashes) - F.lit(SPAN - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def under(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + o) for o in mask]))

    return F.concat(*[under(k, mask) for k, mask in enumerate(MASKS)])


def seeds(texts: DataFrame) -> DataFrame:
    """(key, at, seed): the hash of each masked window of (key, text), and its first word's place."""
    hashed = texts.select("key", word_hashes(F.col("text")).alias("words"))
    windows = hashed.select("key", F.size("words").alias("n"), masked_windows(F.col("words")).alias("windows"))
    # Outer, as for an inner one Spark would compute all windows once more, in a filter on their number. The words stay
    # behind: a long text's would be copied for each of its windows.
    exploded = windows.select("key", "n", F.posexplode_outer("windows").alias("at", "seed")).where("seed IS NOT NULL")
    return exploded.select("key", (F.col("at") % (F.col("n") - (SPAN - 1))).cast("int").alias("at"), "seed")


def short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(key, item, diagonal): where a text first holds an item of under ``SPAN`` words; None without such items."""
    hashed = items.select("key", word_hashes(F.col("text")).alias("words")).where(F.size("words").between(1, SPAN - 1))
    whole = hashed.select(F.col("key").alias("item"), F.size("words").alias("n"), F.xxhash64(F.size("words"), "words").alias("seed"))
    lengths = sorted(row.n for row in whole.select("n").distinct().collect())
    if not lengths:
        return None

    def of_length(n: int) -> Column:
        last = F.size("words") - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        seed = lambda i: F.xxhash64(F.lit(n), F.slice("words", i + 1, n))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), seed(i).alias("seed")))

    windows = docs.select("key", word_hashes(F.col("text")).alias("words")).select(
        "key", F.concat(*map(of_length, lengths)).alias("windows")
    )
    return (
        windows.select("key", F.explode_outer("windows").alias("w"))
        .select("key", "w.at", "w.seed")
        .join(bounded(whole.select("item", "seed"), BROADCAST_SEEDS), "seed")
        .groupBy("key", "item")
        .agg(F.min("at").alias("diagonal"))
    )


def _best_segment(doc: Column, item: Column) -> Column:
    """Matches of the best segment of two aligned arrays; a match scores 1, a substitution -2."""
    pairs = F.zip_with(doc, item, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("found"))

    def step(s: Column, same: Column) -> Column:
        score = F.greatest(F.lit(0), s["score"] + F.when(same == 1, F.lit(1)).otherwise(F.lit(-2)))
        run = F.when(score > 0, s["run"] + same).otherwise(F.lit(0))
        better = score > s["best"]
        return F.struct(
            score.alias("score"),
            run.alias("run"),
            F.when(better, score).otherwise(s["best"]).alias("best"),
            F.when(better, run).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(pairs, zero, step, lambda s: s["found"])


def text_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(whole, item, matched, item_words, first_word) of the contaminated texts, from (key, text) of documents and of items.

    ``whole`` is the text's ``text_key``. The shorter ``key`` goes with every window; where two texts share one, both are compared.
    """
    test = seeds(items).select(F.col("key").alias("item"), F.col("at").alias("item_at"), "seed")
    hits = (
        seeds(docs)
        .join(bounded(test, BROADCAST_SEEDS), "seed")
        .select("key", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    short = short_hits(docs, items)
    hits = materialise(hits if short is None else hits.unionByName(short), "seed-hits")

    # Only texts with a hit are read for their words again, each once, however many rows hold it.
    hit = bounded(hits.select(F.col("key").alias("hit")).distinct(), BROADCAST_HITS)
    held = docs.join(hit, F.col("key") == F.col("hit"), "left_semi")
    held = held.groupBy(text_key(F.col("text")).alias("whole")).agg(F.first("key").alias("key"), F.first("text").alias("text"))
    words = held.select("whole", "key", word_hashes(F.col("text")).alias("words"))
    of_item = items.groupBy(F.col("key").alias("item")).agg(F.first("text").alias("text"))
    of_item = of_item.select("item", word_hashes(F.col("text")).alias("item_hashes"))

    from_doc = F.greatest(F.lit(0), F.col("diagonal"))
    from_item = F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.greatest(F.lit(0), F.least(F.size("item_hashes") - from_item, F.size("words") - from_doc))
    matched = _best_segment(F.slice("words", from_doc + 1, length), F.slice("item_hashes", from_item + 1, length))
    found = (
        hits.join(words, "key")
        .join(of_item, "item")
        .select("whole", "item", from_doc.alias("first_word"), F.size("item_hashes").alias("item_words"), matched.alias("matched"))
    )
    best = found.groupBy("whole", "item").agg(
        F.max(F.struct("matched", (-F.col("first_word")).alias("before"), "item_words")).alias("best")
    )
    enough = F.least(F.lit(MIN_MATCHES), F.ceil(F.col("best.item_words") * F.lit(MIN_SHARE)))
    return best.where(F.col("best.matched") >= enough).select(
        "whole",
        "item",
        F.col("best.matched").cast("long").alias("matched"),
        F.col("best.item_words").cast("long").alias("item_words"),
        (-F.col("best.before")).cast("long").alias("first_word"),
    )


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(text_key(F.col("text")).alias("key"), "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, matched words, words of the item, first word."""
    leaks = materialise(text_leaks(_keyed(docs, text_col), _items(benchmark)), "leaks")
    items = benchmark.select("item_id", text_key(F.col("text")).alias("item"))
    names = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("whole"))
    named = names.join(bounded(leaks.select("whole").distinct(), BROADCAST_HITS), "whole", "left_semi").distinct()
    return named.join(leaks, "whole").join(items, "item").select("doc_id", "item_id", "matched", "item_words", "first_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = BROADCAST_HITS) -> DataFrame:
    """The rows of ``docs`` whose texts no item contaminates, with all their columns."""
    (name,) = fresh_names(docs.columns, "leaked")
    leaks = text_leaks(_keyed(docs, "text"), _items(benchmark))
    leaked = bounded(materialise(leaks.select(F.col("whole").alias(name)).distinct(), "leaks"), max_broadcast)
    return docs.join(leaked, text_key(F.col("text")) == F.col(name), "left_anti")
