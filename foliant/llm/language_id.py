"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes holds how often each byte followed. A byte costs
-log2 of its share in the longest context that was seen; where it never followed there, the code escapes (with the
share d / (n + d), d being the number of distinct followers) to the next shorter context, at last to a uniform byte.
The statistics are frozen after training, so the cost of a byte depends on it and the ``ORDER`` bytes before it only,
and a text's code length is a sum that any split of the text adds up to. The language with the shortest code wins;
the score is its posterior probability under equal priors. A posterior only compares languages: the text of a language that
wasn't learned, or of none, has a best one too. What tells such a text is its code length: ``bits_per_byte`` under the winner is
far above that of the documents it was trained on, whose ``QUANTILE`` the model keeps, by language, as ``usual``.

Training: of the documents with a label and a CRC-32 of the id that isn't 0 modulo 5, those with the least hashes of the
id, in expectation ``TRAIN_BYTES`` of text for each language. That bound is on training alone; prediction reads every
byte. Counting runs on the executors, and only the counts of contexts reach the driver, at most one for each sampled byte.

Prediction runs on Arrow batches. Costs are looked up in a table of ``SLOTS`` entries that each worker fills as contexts
turn up, and contexts that aren't in it are coded from the tree, so memory is bounded and results don't depend on the table.

Of more than ``MOST_LANGUAGES`` labels those with the most text are learned, so the model's size is bounded.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is all if nothing can be learned. Ties go to the
first language by name. A null id is held out. Repeated rows are predicted alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, release, small_batches

ORDER = 3
FOLDS = 5
TRAIN_BYTES = 2_000_000
SLOTS = 1 << 19
#: Labels that are learned at most.
MOST_LANGUAGES = 500
#: Bytes whose costs are summed at once.
PIECE = 1 << 18
#: Bytes that are coded at once: coding takes some hundred bytes for each context that isn't in the table yet.
LOOKUP = 1 << 16
#: Texts, and bytes of them, that a worker gets at once.
BATCH = (500, 4 << 20)
#: The share of a language's training texts whose bits per byte are at most its ``usual`` ones.
QUANTILE = 0.99


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def context_codes(data: np.ndarray) -> np.ndarray:
    """For each byte after the first three, it and the three before it, as one number."""
    wide = data.astype(np.uint32)
    return (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]


class ContextTree:
    """Frozen counts of one language, as sorted arrays for each order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            keys, where = np.unique(codes & mask, return_inverse=True)
            followed = np.bincount(where, weights=counts, minlength=len(keys))
            contexts, where = np.unique(keys >> 8, return_inverse=True)
            distinct = np.bincount(where, minlength=len(contexts)).astype(np.float64)
            total = np.bincount(where, weights=followed, minlength=len(contexts)) + distinct
            cost = -np.log2(followed / total[where])
            self.levels.append((mask, keys, cost, contexts, -np.log2(distinct / total)))

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each code after the bytes before it."""
        bits, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for mask, keys, cost, contexts, escape in reversed(self.levels):
            key = codes & mask
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = open_ & (keys[at] == key)
            bits[hit] += cost[at[hit]]
            open_ &= ~hit
            at = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
            missed = open_ & (contexts[at] == key >> 8)
            bits[missed] += escape[at[missed]]
        bits[open_] += 8
        return bits


class LanguageModel:
    """The trees of all languages and a table of costs that were asked for."""

    def __init__(self, trees: dict[str, ContextTree], usual: dict[str, float] | None = None):
        self.names = sorted(trees)
        self.trees = [trees[name] for name in self.names]
        self.usual = usual or {}
        self.shift = None

    def __getstate__(self):
        return {"names": self.names, "trees": self.trees, "usual": self.usual, "shift": None}

    def _prepare(self) -> None:
        slots = SLOTS
        while slots > 4096 and slots * len(self.names) > 16 * SLOTS:
            slots //= 2
        self.shift = np.uint32(33 - slots.bit_length())
        self.keys = np.zeros(slots, np.uint32)
        self.held = np.zeros(slots, bool)
        self.costs = np.zeros((slots, len(self.names)), np.float32)

    def byte_costs(self, codes: np.ndarray) -> np.ndarray:
        if self.shift is None:
            self._prepare()
        slot = (codes * np.uint32(2654435761)) >> self.shift
        out = self.costs[slot]
        missed = np.flatnonzero((self.keys[slot] != codes) | ~self.held[slot])
        if len(missed):
            fresh, where = np.unique(codes[missed], return_inverse=True)
            found = np.stack([tree.cost(fresh) for tree in self.trees], 1).astype(np.float32)
            out[missed] = found[where]
            slot = (fresh * np.uint32(2654435761)) >> self.shift
            # Two contexts may want one slot: the last one gets both its key and its costs.
            slot, last = np.unique(slot[::-1], return_index=True)
            last = len(fresh) - 1 - last
            self.keys[slot], self.costs[slot], self.held[slot] = fresh[last], found[last], True
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text under each language. ``data``: the texts' bytes, each after ORDER zero bytes."""
        bits = np.zeros((len(ends), len(self.names)))
        starts = np.concatenate([[0], ends[:-1]])
        cost = np.empty((max(0, min(PIECE, len(data) - ORDER)), len(self.names)), np.float32)
        for low in range(0, len(data) - ORDER, PIECE):
            high = min(low + PIECE, len(data) - ORDER)
            for a in range(low, high, LOOKUP):
                b = min(a + LOOKUP, high)
                cost[a - low : b - low] = self.byte_costs(context_codes(data[a : b + ORDER]))
            # The cost at i is that of byte i + ORDER: those of text t are at starts[t] .. ends[t] - ORDER.
            first = np.searchsorted(ends - ORDER, low, "right")
            last = np.searchsorted(starts, high, "left")
            for t in range(first, last):
                a, b = max(starts[t], low) - low, min(ends[t] - ORDER, high) - low
                if b > a:
                    bits[t] += cost[a:b].sum(0, dtype=np.float64)
        return bits

    def classify(self, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """The language, score and bits per byte of each text."""
        data, ends = padded(texts)
        bits = self.code_lengths(data, ends)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
        size = np.diff(np.concatenate([[0], ends])) - ORDER
        return [self.names[i] for i in best], score.tolist(), (least / np.maximum(1, size)).tolist()


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each after ORDER zero bytes, and where each ends."""
    raw = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    gap = bytes(ORDER)
    data = np.frombuffer(gap + gap.join(raw), np.uint8)
    ends = np.cumsum([len(t) + ORDER for t in raw])
    return data, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts of contexts, a batch at a time."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            data, ends = padded(texts)
            codes = context_codes(data)
            # The ORDER positions before each text's end belong to the next text's padding.
            real = np.ones(len(codes), bool)
            for end in ends[:-1]:
                real[end - ORDER : end] = False
            keys, counts = np.unique(codes[real], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "code", "n"],
            )


def training_sample(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, text), written once: for each label some ``train_bytes`` of text, the documents with the least hashes of the id and text."""
    labelled = docs.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # Beyond so many labels, the most frequent are learned; the table of them is then of bounded size.
    sizes = sizes.orderBy(F.col("bytes").desc(), "lang").limit(MOST_LANGUAGES)
    part = F.least(F.lit(1.0), F.lit(float(train_bytes)) / F.col("bytes"))
    sample = (
        labelled.join(F.broadcast(sizes), "lang")
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.ceil(part * (1 << 20)))
        .select("lang", "text")
    )
    return materialise(sample, "language-sample")


def train(sample: DataFrame) -> LanguageModel:
    """Learn from (lang, text)."""
    small_batches(sample.sparkSession)
    counts = sample.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counts.column("lang").to_pylist(), object)
    codes = counts.column("code").to_numpy().astype(np.uint32)
    numbers = counts.column("n").to_numpy().astype(np.float64)
    return LanguageModel({lang: ContextTree(codes[langs == lang], numbers[langs == lang]) for lang in sorted(set(langs))})


def learn_usual(sample: DataFrame, model: LanguageModel) -> LanguageModel:
    """``model`` with the usual bits per byte of each language, from the texts it was trained on."""
    found = identify(sample, model, out="found").where("found.lang_pred = lang")
    usual = found.groupBy("lang").agg(F.percentile_approx("found.bits_per_byte", QUANTILE, 1000).alias("bits")).collect()
    model.usual = {row.lang: row.bits for row in usual}
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns of ``docs``, with a struct ``out`` of lang_pred, score and bits_per_byte."""
    kind = "struct<lang_pred: string, score: double, bits_per_byte: double>"
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if not model.names:
        return docs.withColumn(out, nothing.cast(kind))
    small_batches(docs.sparkSession, *BATCH)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, rates = shared.value.classify(texts)
        release()
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "bits_per_byte"])

    text = F.col(text_col)
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(out, predict(text)).withColumn(out, F.when(has_letter, F.col(out)).otherwise(nothing.cast(kind)))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train(training_sample(docs))).select(
        "doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score"
    )
