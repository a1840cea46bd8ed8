"""N-gram Jaccard self-join as a blocked sparse matrix product.

Rows of the matrix are documents, columns are word shingles. Two documents link when their Jaccard similarity is at
least ``num / den``. Documents with equal shingle sets are one class and one row; classes are never expanded into pairs.

1. Blocks. Sets of n and m >= n shingles that link differ in at most n (den - num) / num of them. The hash range is cut into
   more parts than that, so at least one non-empty part is the same in both; its hash, under the size class of the smaller
   set, is a signature. Each set signs for its own size class and, if it can be the larger of a pair, for the class below;
   classes are so wide that a partner is in the same or the next. Hot shingles, those of passages that many documents share, are
   left out of the parts, since a part that holds nothing else would bring all those documents together; what is left of
   two sets differs no more than the sets do. A set with too many empty parts for the argument also signs with each shingle of
   its prefix, hot ones last, so that two such sets meet as well. Sets that share a signature fall in the same
   candidate component. Of the sets that a worker holds at a time a signature is kept once, its other sets being tied to the
   first by signatures of their own; a signature that a third of all documents have costs a few rows a worker.
2. Product. The rows of a candidate component are dealt by hash into row blocks, each expected to have half of a piece's rows and
   shingles at most, and each pair of blocks is one piece of work, so that a large group is many pieces: row by row, overlap counts with all rows that are not yet in the same group are accumulated column block
   by column block, first over the rarest columns of each partner's prefix, after which pairs without an overlap are
   discarded, and rows out of the size bounds never enter. A piece gives a spanning forest of its links, never all pairs.
3. Components of those forests by alternating star passes.

The result is exact but for collisions of 64-bit shingle hashes; no link between different sets is lost, and nothing is capped.

Cases: words are what is between ASCII white space, A to Z lower-cased; a text of fewer than ``k`` words is one shingle;
a null text or one without words has none and links with nothing. A component's id is its least doc_id; null ids are
ignored in that unless there is no other. Rows that repeat a text are in one class; rows that share an id but not a text are
documents of their own. An empty table gives no rows. ``ngram_components`` ignores other columns, ``keep_one`` carries them along,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm.common import bounded, discard, fresh_names, materialise, release, small_batches
from foliant.llm.components import connected_components

SHINGLE = 5
SIMILARITY = (80, 100)
#: A piece, two row blocks, holds about this many documents and this many shingles at most.
PIECE_ROWS = 1024
PIECE_SHINGLES = 4_000_000
#: Signatures that a worker holds at once to tie equal ones: tying takes some hundred bytes for each.
SIGNATURES_HELD = 500_000
#: Words whose hashes a worker keeps, some hundred bytes for each.
WORDS_HELD = 100_000
#: Lists of ids up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_IDS = 500_000

#: Shingles that meet in HOT_LEAST of every HOT_PART-th of the texts count as hot, the HOT_MOST most frequent at most.
HOT_PART = 32
HOT_LEAST = 4
HOT_MOST = 1_000_000

NONE = np.empty(0, np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _WordHashes()


def forget() -> None:
    _WORDS.clear()
    release()


def forgetting(run):
    """``run`` for a worker that keeps neither words nor freed memory once a task has ended: it may idle beside later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return NONE
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    rows = len(words) - width + 1
    folded = np.full(rows, width, np.uint64)
    for i in range(width):
        folded = folded * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + rows]
    return np.unique(mix(folded))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


@lru_cache(1 << 16)
def size_class(n: int, num: int, den: int) -> tuple[int, int, int]:
    """(class, its least size, the least size of the next) of sets of n shingles."""
    k, low = 0, 1
    while True:
        high = low * den // num + 1
        if n < high:
            return k, low, high
        k, low = k + 1, high


def parts_of(high: int, num: int, den: int) -> tuple[int, int]:
    """(parts, most differences) of the class whose sizes are below ``high``."""
    differ = (high - 1) * (den - num) // num
    return differ + 1 + -(-8 * (differ + 1) // 100), differ


def signatures(shingles: np.ndarray, num: int, den: int, hot: np.ndarray = NONE) -> np.ndarray:
    """Hashes of which two linking, different sets share at least one, whatever shingles are ``hot`` (sorted)."""
    n = len(shingles)
    at = np.minimum(np.searchsorted(hot, shingles), max(0, len(hot) - 1))
    common = hot[at] == shingles if len(hot) else np.zeros(n, bool)
    rare = shingles[~common]
    k, low, high = size_class(n, num, den)
    tops = [(k, high)]
    if k and n * num <= (low - 1) * den:
        tops.append((k - 1, low))
    out = []
    for level, top in tops:
        parts, differ = parts_of(top, num, den)
        if not differ:
            continue
        starts = NONE
        if len(rare):
            part = ((rare >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.add.reduceat(mix(rare), starts)
            tag = mix(part[starts] + np.uint64(level << 40) + np.uint64(1))
            out.append(mix(sums + tag))
        if len(starts) <= min(differ, n * (den - num) // num):
            prefix = n - -(-n * num // den) + 1
            ordered = np.concatenate([rare, shingles[common]])
            out.append(mix(ordered[:prefix] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.unique(np.concatenate(out)) if out else NONE


def hot_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many documents have, by counts on a part of the documents, sorted.

    The list only decides which shingles sets meet by, never which meet: a poor one costs time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), k) for text in batch.column(0)]
            found, n = np.unique(np.concatenate([NONE, *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(found), pa.array(n)], ["shingle", "n"])

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_PART)) == 0).select("text").distinct()
    counted = part.mapInArrow(forgetting(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= HOT_LEAST).orderBy(F.col("n").desc()).limit(HOT_MOST).select("shingle").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: What ``sign`` yields: rows of signatures (sig, node), and for each document a row with the null signature.
SIGNED = "sig long, node long, doc_id long, text_hash long, n long, digest binary"


def sign(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray = NONE) -> DataFrame:
    """(doc_id, text_hash, n, digest, node) of every document, and (sig, node) of its signatures, each text being read once.

    Of sets held together, those that share a signature are tied to the first.
    """

    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = [part.split()[0] for part in SIGNED.split(", ")]

    def signature_rows(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(sig), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([_longs(sig), _longs(node), *none], names)

    def document_rows(ids: pa.Array, hashes: pa.Array, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = [
            pa.nulls(len(found), pa.int64()),
            pa.array([node_of(d) for _, d in found], pa.int64()),
            ids,
            hashes,
            pa.array([n for n, _ in found], pa.int64()),
            pa.array([d for _, d in found], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def tied(found: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([s for _, s in found])
        node = np.repeat(np.array([n for n, _ in found], np.int64).view(np.uint64), [len(s) for _, s in found])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
        head = node[np.flatnonzero(first)][np.cumsum(first) - 1]
        # The tie between a set and the first: a signature that these two alone have.
        ties, once = np.unique(mix(node[~first] ^ mix(head[~first])), return_index=True)
        sig = np.concatenate([sig[first], ties, ties])
        node = np.concatenate([node[first], node[~first][once], head[~first][once]])
        # A set's rows follow each other, so that its number compresses well.
        order = np.argsort(node, kind="stable")
        sig, node = sig[order], node[order]
        for at in range(0, len(sig), 100_000):
            cut = slice(at, at + 100_000)
            yield signature_rows(sig[cut], node[cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, size = [], set(), 0
        for batch in batches:
            described = []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), k)
                digest = set_digest(shingles)
                described.append((len(shingles), digest))
                if len(shingles) and digest not in seen:
                    seen.add(digest)
                    found.append((node_of(digest), signatures(shingles, num, den, shared.value)))
                    size += len(found[-1][1])
                if size >= SIGNATURES_HELD:
                    yield from tied(found)
                    found, seen, size = [], set(), 0
            yield document_rows(batch.column(0), batch.column(1), described)
        if found:
            yield from tied(found)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(forgetting(run), SIGNED)


def _placed_sets(docs: DataFrame, k: int) -> DataFrame:
    """(root, blocks, block, digest, shingles) of rows (text, member, root, blocks) whose set is the member's.

    The set comes as packed 64-bit numbers; a row whose keys stand for another text's set is left out, and so are repeats of a set
    that a worker has placed.
    """
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary())

    def rows(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "root", "blocks", "shingles"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            held, size = [], 0
            for text, member, root, blocks in zip(*batch.columns, strict=True):
                digest = member.as_py()
                if digest in seen:
                    continue
                shingles = shingle_set(text.as_py(), k)
                if set_digest(shingles) == digest:
                    if len(seen) >= SIGNATURES_HELD:
                        seen.clear()
                    seen.add(digest)
                    held.append((digest, root.as_py(), blocks.as_py(), shingles.tobytes()))
                    size += shingles.nbytes
                if size > 4 << 20:
                    yield rows(held)
                    held, size = [], 0
            yield rows(held)

    held = docs.select("text", "member", "root", "blocks")
    found = held.mapInArrow(forgetting(run), "digest binary, root long, blocks int, shingles binary")
    return found.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))


def product_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, as pairs of their places."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    _, columns, weight = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # Columns get numbers by rarity; each row lists its columns from the rarest on.
    rank = np.empty(len(weight), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(weight))
    columns = rank[columns]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns = columns[np.lexsort((columns, rows))]
    prefix = sizes + (-(-sizes * num // den) * -1) + 1

    group = np.arange(len(sizes))
    mark = np.zeros(len(weight), bool)
    links = []
    for x in range(len(sizes) - 1):
        upto = np.searchsorted(sizes, sizes[x] * den // num, "right")
        others = np.arange(x + 1, upto)
        others = others[group[others] != group[x]]
        if not len(others):
            continue
        own = columns[bounds[x] : bounds[x + 1]]
        mark[own] = True
        others = others[_overlaps(columns, bounds[others], prefix[others], mark) > 0]
        if len(others):
            both = _overlaps(columns, bounds[others], sizes[others], mark)
            for y in others[den * both >= num * (sizes[x] + sizes[others] - both)]:
                if group[x] != group[y]:
                    links.append((order[x], order[y]))
                    group[group == group[y]] = group[x]
        mark[own] = False
    return links


def _overlaps(columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each stretch of ``columns`` the number that ``mark`` has."""
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
    return np.add.reduceat(mark[columns[places]].astype(np.int64), ends - lengths)


def _block_links(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between digests, from rows sorted by piece."""

    def pieces(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, rows in groupby(pieces(batches), key=lambda r: r[:3]):
            held = {digest: np.frombuffer(packed, np.uint64) for _, _, _, digest, packed in rows}
            names = sorted(held)
            if len(names) > 1:
                for a, b in product_links([held[d] for d in names], num, den):
                    left.append(names[a])
                    right.append(names[b])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return blocks.mapInArrow(forgetting(run), "a binary, b binary")


def ngram_components(
    docs: DataFrame,
    k: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id."""
    return _components(docs, k, similarity, id_col, text_col)[0]


def _components(
    docs: DataFrame, k: int, similarity: tuple[int, int], id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and the tables that it reads."""
    num, den = similarity
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot = hot_shingles(docs, k)
    signed = materialise(sign(docs, k, num, den, hot), "ngram-signed")
    rows = signed.where("sig IS NULL").select("doc_id", "text_hash", "n", "digest", "node")
    # The row that stands for a class: the least id, if any row has one, and a hash of its text.
    of_id = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = materialise(
        rows.where("n > 0")
        .groupBy("digest")
        .agg(F.min(of_id).alias("first"), F.max("n").alias("n"), F.max("node").alias("node"))
        .select("digest", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"), "n", "node"),
        "ngram-classes",
    )

    hub = F.min("node").over(Window.partitionBy("sig"))
    edges = (
        signed.where("sig IS NOT NULL")
        .select("sig", "node")
        .withColumn("hub", hub)
        .where(F.col("hub") != F.col("node"))
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    near = materialise(connected_components(edges), "ngram-candidates")

    # The classes of candidate components, and into how many row blocks each component is dealt.
    members = materialise(
        classes.join(near, "node").select("digest", "least", "text_hash", "n", "root"), "ngram-members"
    )
    wide = F.greatest(F.count("*") / F.lit(PIECE_ROWS), F.sum("n") / F.lit(PIECE_SHINGLES))
    # One piece as long as all fits into it; else blocks of half a piece.
    blocks = F.when(wide <= 1, F.lit(1)).otherwise(F.ceil(2 * wide))
    shape = members.groupBy("root").agg(blocks.cast("int").alias("blocks"))
    placed = members.join(shape, "root").select(
        F.col("least").alias("wanted"), F.col("text_hash").alias("wanted_hash"), F.col("digest").alias("member"), "root", "blocks"
    )
    if members.count() <= BROADCAST_IDS:
        placed = F.broadcast(placed)
    wanted = (F.xxhash64("text") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("wanted"))
    sets = _placed_sets(docs.join(placed, wanted), k)

    i, j = F.col("block"), F.col("other")
    blocks = (
        sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where((F.col("blocks") == 1) | (i != j))
        .select("root", F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "digest", "shingles")
    )
    spread = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = materialise(_block_links(spread, num, den), "ngram-links")
    linked = materialise(connected_components(links), "ngram-components")

    named = classes.join(linked.withColumnRenamed("node", "of"), F.col("digest") == F.col("of"), "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root")
    )
    least_of = named.groupBy("root").agg(F.min("least").alias("component"))
    # Written, so that the join below shuffles both of its sides and can split a large class.
    labels = materialise(named.join(least_of, "root").select("digest", "component"), "ngram-labels")
    discard(near, members, links, linked, classes)
    found = rows.join(labels, "digest", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return found, [signed, labels]


def keep_one(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of each component the row with the least doc_id, and of those the least text hash, once, with all its columns.

    Rows without an id or without words link with nothing that an id could name, and stay, repeats too.
    """
    of_id, of_hash = fresh_names(docs.columns, "near_id", "near_hash")
    found, tables = _components(docs, k, similarity)
    found = materialise(found, "ngram-found").where("n_shingles > 0 AND doc_id IS NOT NULL")
    discard(*tables)
    # The least hash is asked for only where texts share the least id; other rows of the component go by their id.
    same = found.where("component_id = doc_id").groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.count("*").alias("n"))
    shared = materialise(same.where("n > 1"), "ngram-shared")
    others = found.where("component_id = doc_id").join(bounded(shared, BROADCAST_IDS), "doc_id").where("text_hash <> least")
    lost = found.where("component_id <> doc_id").select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    lost = materialise(lost.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)).distinct(), "ngram-lost")
    is_it = (F.col("doc_id") == F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash))
    kept = docs.join(bounded(lost, BROADCAST_IDS), is_it, "left_anti")
    if shared.isEmpty():
        return kept
    # Only rows of the keepers that occur more than once are compared with each other.
    again = bounded(shared.select(F.col("doc_id").alias(of_id), F.col("least").alias(of_hash)), BROADCAST_IDS)
    once = kept.join(again, is_it, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, is_it, "left_anti").unionByName(once)
