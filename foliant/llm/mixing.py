"""Temperature mixing of sources to target weights.

A source with the share p of all tokens gets a weight in proportion to ``p ** alpha``. The exponent is
bisected between 0 (all sources equal) and 1 (as they are): for a target entropy the largest alpha whose
weights reach it, for a repetition limit the least alpha at which no source is repeated more often than
that. The budget of a source is its weight times the token budget; without a stated budget it is the least
one at which every source is used in full at least once, so that nothing is dropped.

A budget is spent in epochs. In each, the source's documents come in a new permutation, made in two steps so
that no task sorts a source: a hash of (epoch, id) deals documents into blocks of some thousand, the blocks'
token counts give each block its place, and a window orders each block. All whole epochs are taken; of the
last one, documents as long as the budget lasts. ``mix_key`` is the part of its source's budget that comes
before a document: sorted by it, any stretch of the stream has the sources in their weights.

A document's place is given by (block, hash, id, hash of the text), so the last epoch ends at one such place in each source:
``draw_mix`` finds it among the documents of the one block where the budget ends, and then decides every row by itself, without
moving its text. A target entropy alone can ask for very many epochs of a tiny source; ``max_epochs``, ``MOST_EPOCHS`` unless stated,
bounds them then as well, and the exponent is the larger of the two.

Each round of the bisection evaluates 15 inner points in one aggregation over the table of sources, and only
those 17 rows reach the driver, so the number of sources isn't limited.

Cases: tokens are words between white space; a null or empty text has none, and costs none. A null source is
a source of its own. A source without tokens has weight 0 and passes once. Repeated rows are documents of
their own; rows that agree in id and text share a place in the permutation, and where a budget ends among them it pays for as many of
them as it can. An empty table gives no rows. ``mix_sources`` ignores other columns, ``draw_mix`` carries all along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm.common import bounded, fresh_names, materialise

#: No source of the production mix is repeated more often than this.
MAX_EPOCHS = 2.0
#: With a target entropy, unless stated.
MOST_EPOCHS = 100.0
ROWS_PER_BLOCK = 2_000
SECTIONS = 16
ROUNDS = 8
#: Tables of sources up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_SOURCES = 100_000


def count_tokens(text):
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def solve_exponent(
    sources: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget: float | None = None,
) -> float:
    """The exponent for a target entropy, in bits, or for a repetition limit.

    ``sources`` has a column ``tokens``. Where even alpha 0 can't reach the entropy it is 0; where even
    alpha 1 repeats too often, because the budget is larger than the corpus, it is 1.
    """
    if target_entropy is None and max_epochs is None:
        raise ValueError("give a target entropy or a repetition limit")
    if target_entropy is not None and max_epochs is not None:
        return max(solve_exponent(sources, target_entropy, None, budget), solve_exponent(sources, None, max_epochs, budget))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 1.0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def fits(row) -> bool:
        if target_entropy is not None:
            entropy = (math.log(row.z) - row.a * row.zl / row.z) / math.log(2)
            return entropy >= target_entropy - 1e-12
        # Epochs of a source: weight * budget / tokens = p ** (a - 1) / z * budget / total.
        scale = 1 / row.least if budget is None else budget / total / row.z
        return row.most * scale <= max_epochs * (1 + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        power = F.pow("p", "a")
        rows = (
            shares.select("p", F.explode(F.array(*[F.lit(x) for x in points])).alias("a"))
            .groupBy("a")
            .agg(
                F.sum(power).alias("z"),
                F.sum(power * F.log("p")).alias("zl"),
                F.max(F.pow("p", F.col("a") - 1)).alias("most"),
                F.min(F.pow("p", F.col("a") - 1)).alias("least"),
            )
            .collect()
        )
        good = sorted(r.a for r in rows if fits(r))
        if target_entropy is not None:
            if not good:
                return 0.0
            low = good[-1]
            high = min((x for x in points if x > low), default=low)
        else:
            if not good:
                return 1.0
            high = good[0]
            low = max((x for x in points if x < high), default=high)
        if low == high:
            break
    return low if target_entropy is not None else high


def source_budgets(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget: float | None = None,
) -> DataFrame:
    """For each source: source, tokens, n_docs, alpha, weight, budget, whole epochs, rest of the budget.

    ``docs`` has the columns source and tokens.
    """
    sources = materialise(
        docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-sources"
    )
    alpha = solve_exponent(sources, target_entropy, max_epochs, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    raw = sources.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha))).otherwise(0.0))
    z, full = raw.where("tokens > 0").agg(F.sum("raw"), F.max(F.col("tokens") / F.col("raw"))).first()
    spent = float(budget) if budget is not None else (full or 0.0) * (z or 0.0)
    weighted = raw.withColumn("weight", F.col("raw") / F.lit(z or 1.0)).withColumn("budget", F.col("weight") * F.lit(spent))
    # A budget that is a whole number of epochs but for rounding counts as that number.
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9))).otherwise(1)
    return weighted.withColumn("whole", epochs.cast("int")).select(
        "source",
        "tokens",
        "n_docs",
        F.lit(alpha).alias("alpha"),
        "weight",
        "budget",
        "whole",
        F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"),
    )


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, tie, n_tokens): the keys of each document, without its text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("tie"),
        count_tokens(F.col(text_col)).alias("n_tokens"),
    )


def _block(seed: int, epoch: Column, doc_id: Column, tie: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), epoch, doc_id, tie), blocks)


def _place(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """What a block is sorted by; a null id comes first."""
    return F.struct(F.xxhash64(F.lit(seed + 1), epoch, doc_id, tie).alias("dice"), doc_id.alias("doc_id"), tie.alias("tie"))


class Plan:
    """The keys of all documents, written once, and the budgets of their sources."""

    def __init__(self, docs, target_entropy, max_epochs, budget, id_col="doc_id", source_col="source", text_col="text"):
        if max_epochs is None:
            max_epochs = MAX_EPOCHS if target_entropy is None else MOST_EPOCHS
        self.rows = materialise(_rows(docs, id_col, source_col, text_col), "mix-rows")
        tokens = self.rows.select("source", F.col("n_tokens").alias("tokens"))
        budgets = materialise(source_budgets(tokens, target_entropy, max_epochs, budget), "mix-budgets")
        budgets = budgets.withColumn("blocks", F.ceil(F.col("n_docs") / F.lit(ROWS_PER_BLOCK)))
        self.budgets = bounded(budgets.withColumnRenamed("source", "name"), BROADCAST_SOURCES)

    def used(self, first_epoch: Column, seed: int) -> DataFrame:
        """The rows in every epoch from the given one to the last, each with its block and place."""
        last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
        return (
            self.rows.join(self.budgets, F.col("source").eqNullSafe(F.col("name")))
            .where(last >= first_epoch)
            .withColumn("epoch", F.explode(F.sequence(first_epoch, last)))
            .withColumn("block", _block(seed, F.col("epoch"), F.col("doc_id"), F.col("tie"), F.col("blocks")))
            .withColumn("place", _place(seed, F.col("epoch"), F.col("doc_id"), F.col("tie")))
        )


def _block_starts(used: DataFrame) -> DataFrame:
    """(of_source, of_epoch, of_block, before_block, block_tokens): the tokens of a source's epoch before each of its blocks."""
    key = ["source", "epoch", "block"]
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return used.groupBy(key).agg(F.sum("n_tokens").alias("block_tokens")).select(
        *[F.col(c).alias(f"of_{c}") for c in key],
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("before_block"),
        "block_tokens",
    )


def _through() -> Column:
    """The tokens of a block up to and with a row."""
    block = Window.partitionBy("source", "epoch", "block").orderBy("place")
    return F.sum("n_tokens").over(block.rowsBetween(Window.unboundedPreceding, 0))


def _at_start() -> Column:
    return (
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("epoch") == F.col("of_epoch")) & (F.col("block") == F.col("of_block"))
    )


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """One row for each use of a document: doc_id, source, epoch, n_tokens, mix_key, weight, alpha."""
    plan = Plan(docs, target_entropy, max_epochs, budget, id_col, source_col, text_col)
    used = plan.used(F.lit(0), seed)
    placed = used.withColumn("through", _through()).join(_block_starts(used), _at_start())
    start = F.col("before_block") + F.col("through") - F.col("n_tokens")
    return placed.where((F.col("epoch") < F.col("whole")) | (F.col("before_block") + F.col("through") <= F.col("rest"))).select(
        "doc_id",
        "source",
        "epoch",
        "n_tokens",
        F.when(F.col("budget") > 0, (F.col("epoch") * F.col("tokens") + start) / F.col("budget")).otherwise(0.0).alias("mix_key"),
        "weight",
        "alpha",
    )


def draw_mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = None,
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs`` that ``mix_sources`` uses, with all their columns, each as often as it is used."""
    plan = Plan(docs, target_entropy, max_epochs, budget, id_col, source_col, text_col)
    final = plan.used(F.col("whole"), seed)
    # The one block of each source in which its budget ends, and the last place in it that the budget pays for.
    starts = materialise(_block_starts(final.where("rest > 0")), "mix-starts")
    ending = (
        starts.join(plan.budgets, F.col("of_source").eqNullSafe(F.col("name")))
        .where((F.col("before_block") <= F.col("rest")) & (F.col("before_block") + F.col("block_tokens") > F.col("rest")))
        .select("of_source", "of_epoch", "of_block", "before_block")
    )
    ending = materialise(ending, "mix-ends")
    paid = F.col("before_block") + F.col("through") <= F.col("rest")
    # At a place, rows that repeat an id and a text: the last place that is paid for may be so in part.
    places = (
        final.join(bounded(ending, BROADCAST_SOURCES), _at_start())
        .withColumn("through", _through())
        .groupBy("source", "place")
        .agg(F.count("*").alias("n"), F.count_if(paid).alias("paid"))
        .where("paid > 0")
    )
    ends = places.groupBy("source").agg(F.max(F.struct("place", "paid", "n")).alias("last"))
    ends = materialise(
        ending.select(F.col("of_source").alias("end_of"), F.col("of_block").alias("end_block")).join(
            ends.withColumnRenamed("source", "paid_of"), F.col("end_of").eqNullSafe(F.col("paid_of")), "left"
        ).select("end_of", "end_block", "last"),
        "mix-upto",
    )
    names = fresh_names(docs.columns, "mix_source", "mix_whole", "mix_rest", "mix_blocks", "mix_block", "mix_last", "mix_uses")
    of, whole, rest, blocks, end_block, last, uses = names
    cuts = plan.budgets.join(ends, F.col("name").eqNullSafe(F.col("end_of")), "left").select(
        F.col("name").alias(of),
        F.col("whole").alias(whole),
        F.col("rest").alias(rest),
        F.col("blocks").alias(blocks),
        F.col("end_block").alias(end_block),
        F.col("last").alias(last),
    )
    cuts = materialise(cuts, "mix-cuts")
    key = (F.col(whole), F.col(id_col), F.xxhash64(text_col))
    block, place = _block(seed, *key, F.col(blocks)), _place(seed, *key)
    at_end = block == F.col(end_block)
    split = F.col(last).isNotNull() & (F.col(last)["paid"] < F.col(last)["n"])
    in_block = (place < F.col(last)["place"]) | ((place == F.col(last)["place"]) & ~split)
    paid_for = F.col(end_block).isNull() | (block < F.col(end_block)) | (at_end & F.coalesce(in_block, F.lit(False)))
    times = F.col(whole) + F.when((F.col(rest) > 0) & paid_for, F.lit(1)).otherwise(F.lit(0))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(bounded(cuts, BROADCAST_SOURCES), F.col(source_col).eqNullSafe(F.col(of)))
    drawn = joined.withColumn(uses, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*columns)
    if cuts.where(split).isEmpty():
        return drawn
    among = F.row_number().over(Window.partitionBy(of).orderBy(F.lit(0)))
    repeats = joined.where(split & at_end & (place == F.col(last)["place"])).withColumn(uses, among)
    return drawn.unionByName(repeats.where(F.col(uses) <= F.col(last)["paid"]).select(*columns))
