"""Each operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns, against brute force."""

import base64
import hashlib
import io
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, language_id, line_dedup, mixing, ngram_join, sharding, url_filter, warc
from foliant.llm.components import connected_components

#: Rows that every operator on documents must stand: nulls in any column, ties, repeats, long texts, no ids.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one line only of some length, with more than forty letters", "en", "a"),
    (3, "one line only of some length, with more than forty letters", "en", "a"),
    (4, "one line only of some length, with more than forty letters", None, "b"),
    (5, LONG, "fr", "b"),
    (6, LONG + " end", "fr", None),
    (7, LONG, "fr", "c"),
    (None, "no id here\nat all", "de", "c"),
    (None, LONG, "de", "c"),
    (8, "\n\n\r\n \t", "de", "c"),
    (9, "été ÉTÉ 🙂", "fr", "c"),
    (3, "another text under a repeated id", "en", "a"),
]
EXTRA = "doc_id long, text string, lang string, source string, size long, shard int, digest binary, group long, n long"


def odd(spark, rows=ODD):
    """The odd rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 7, bytearray(b"x"), 7, 7) for r in rows], EXTRA)


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(odd(spark)).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in ODD:
        groups[text or ""].append(doc_id)
    assert len(got) == len(ODD)
    want = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_splits_at_any_depth(spark):
    base = "x" * 200_000
    texts = [base, base, base[:-1] + "y", base[:600] + "z" + base[601:], base + "x", "y" + base[1:], "x" * 32, "x" * 32, "x" * 31 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (7, 2), 7: (7, 2), 8: (8, 1)}


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_line_dedup(spark, batches):
    dice = random.Random(batches)
    common = [f"Common line number {i} which is long enough to count" for i in range(12)]
    rows = [(d, t) for d, t, *_ in ODD]
    for doc_id in range(100, 160):
        lines = [dice.choice(common) for _ in range(dice.randrange(6))] + [f"its own {doc_id} {'z' * dice.randrange(60)}"]
        lines = [x if dice.random() < 0.5 else f" \t{x.upper()}\r" for x in lines]
        dice.shuffle(lines)
        rows.append((doc_id, "\n".join(lines)))
    rows += [(None, common[0]), (None, common[0]), (120, common[1]), (159, common[2] + "\n" + common[2])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, lost string, keeper int")
    got = line_dedup.line_dedup(docs, batches=batches)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)


def brute_components(rows, k, num, den):
    """(doc_id, size of the set, least id of the component) for each row."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        width = min(k, len(words))
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    name = lambda i: min((x for x in least[root(i)] if x is not None), default=None)
    return Counter((doc_id, len(sets[i]), name(i) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        at = dice.randrange(len(words))
        what = dice.randrange(3)
        if what == 0:
            words[at] = f"e{dice.randrange(9999)}"
        elif what == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{dice.randrange(9999)}")
    return words


def near_corpus(seed):
    """Groups of edited copies of many sizes and degrees, chains of edits, short texts and shared passages."""
    dice = random.Random(seed)
    say = lambda n: [f"w{dice.randrange(3000)}" for _ in range(n)]
    rows = [(d, t) for d, t, *_ in ODD]
    doc_id = 1000
    passage = say(60)
    for size in (5, 8, 9, 12, 20, 40, 80, 160, 400):
        for _ in range(4):
            base = say(size)
            chain = base
            for _ in range(6):
                chain = edited(dice, chain, max(1, size // 80))
                for words in (edited(dice, base, dice.randrange(0, 1 + size // 25)), chain):
                    rows.append((doc_id, " ".join(words)))
                    doc_id += 1
            at = dice.randrange(size)
            rows.append((doc_id, " ".join(base[:at] + passage + base[at:])))
            doc_id += 1
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 3, 60, 100)])
def test_ngram_components_equal_all_pairs(spark, monkeypatch, seed, k, num, den):
    rows = near_corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, n int, digest binary")
    want = brute_components(rows, k, num, den)
    # Small blocks, so that large components are dealt over several.
    monkeypatch.setattr(ngram_join, "PIECE_ROWS", 5)
    monkeypatch.setattr(ngram_join, "HOT_PART", seed)
    got = ngram_join.ngram_components(docs.repartition(7), k, (num, den)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    linked = Counter(c for _, _, c in want.elements() if c is not None)
    assert max(linked.values()) > 5


def test_signatures_meet_for_every_link():
    dice = np.random.default_rng(4)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        for n in (6, 7, 12, 13, 30, 57, 200, 1200):
            for _ in range(60):
                a = np.unique(dice.integers(0, 1 << 63, n).astype(np.uint64))
                cut, add = int(dice.integers(0, n // 3 + 1)), int(dice.integers(0, n // 3 + 1))
                b = np.unique(np.concatenate([a[dice.permutation(len(a))[cut:]], dice.integers(0, 1 << 63, add).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and both < max(len(a), len(b)) and den * both >= num * (len(a) + len(b) - both):
                    for share in (0, 0.2, 0.9, 1):
                        hot = np.unique(dice.permutation(np.union1d(a, b))[: int(share * len(a))])
                        meet = np.intersect1d(ngram_join.signatures(a, num, den, hot), ngram_join.signatures(b, num, den, hot))
                        assert len(meet)


def test_keep_one(spark):
    rows = near_corpus(2)
    kept = ngram_join.keep_one(odd(spark, [(d, t, "en", "s") for d, t in rows])).collect()
    want = brute_components(rows, 5, 80, 100)
    alone = [(d, t) for d, t in rows if d is None or not (t or "").split()]
    names = {c for _, n, c in want if n and c is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None and (r.text or "").split()} == names
    assert Counter((r.doc_id, r.text) for r in kept if r.doc_id is None or not (r.text or "").split()) == Counter(alone)
    assert len(kept[0]) == 9


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_url_filter(spark):
    urls = [
        None, "", "example.net/en/", "http://net", "http://net/", "https://A.Example.NET/en/x?y#z", "http://example.net/EN/",
        "http://example.com/de/", "http://xexample.com/de/", "http://m.example.com/de", "ftp://org/fr/#a", "http://a.org?x=/fr/",
        "http://a.org/fr/b://c", "http:///fr/", "http://example.net.evil/en/", "http://ünï.net/", "http://a..net/x", "x" * 50_000 + "://net/" + "y" * 50_000,
    ]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://net/", "h", "p"), (4, "http://net/", "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()
    want = Counter((i, *brute(u)) for i, u, _, _ in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    bare = url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES).limit(0))
    assert {r.verdict for r in bare.collect()} == {"allow"}


def pages_of(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "é", "é🙂\r\n\r\n" * 3), (None, "n", "same"), (6, "u", "z" * 3_000_000)]
    rows += [(5, "é", "é🙂\r\n\r\n" * 3), (None, "n", "alone")]
    return rows, spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    rows, pages = pages_of(spark)
    folder = f"file://{tmp_path}/archives"
    payloads = [(i, None, f"<p>page {i} of many pages with much the same words</p>" * 40) for i in range(100, 140)]
    pages = pages.unionByName(spark.createDataFrame([(*r, 9) for r in payloads], pages.schema))
    dictionary = warc.train_dictionary(pages)
    assert dictionary
    manifest = warc.write_archives(pages, folder, dictionary)
    top = {"same": 2, "": 4, "é🙂\r\n\r\n" * 3: 5}
    for got in (warc.read_archives(manifest).collect(), warc.read_archive_folder(spark, folder).collect()):
        assert len(got) == len(rows) + len(payloads)
        want = Counter()
        for page_id, url, html in rows + payloads:
            data = (html or "").encode()
            first = top.get(html or "", page_id)
            revisit = page_id != first
            want[(page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                  first if revisit else None, b"" if revisit else data)] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert "http://a/%0D%0AX: y" in {r.target_uri for r in got}


def test_warc_reader_rejects_damage():
    import zstandard

    held = zstandard.ZstdCompressionDict(zstandard.train_dictionary(4096, [f"<p>{i} some page</p>".encode() * 30 for i in range(300)]).as_bytes())
    encode = zstandard.ZstdCompressor(dict_data=held).compress
    record = warc.build_record(7, "http://a/", b"hello", None)
    plain = warc.dictionary_frame(held.as_bytes())
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(held.as_bytes()))
    for lead in (plain, packed):
        read = list(warc.read_records(io.BytesIO(lead + encode(record) * 3)))
        assert [r["page_id"] for r in read] == [7] * 3 and read[0]["payload"] == b"hello" and read[1]["offset"] > read[0]["offset"]
    undictionaried = zstandard.ZstdCompressor().compress(record)
    assert len(list(warc.read_records(io.BytesIO(undictionaried)))) == 1 and not list(warc.read_records(io.BytesIO(b"")))
    broken = (
        record.replace(b"Content-Length: 5", b"Content-Length: 6", 1),
        record.replace(b"WARC-Date", b"WARC-Dat"),
        record.replace(b"hello", b"hullo"),
        record[:-2],
        record + b"x",
        record.replace(b"WARC/1.1", b"WARC/9.9"),
    )
    for bad in broken:
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(zstandard.ZstdCompressor().compress(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(plain + encode(record)[:-3])))


def test_sharding(spark):
    dice = random.Random(3)
    rows = [(d, t) for d, t, *_ in ODD] + [(1000 + i, "x" * dice.randrange(4000)) for i in range(3000)] + [(9000 + i, "copy" * 50) for i in range(900)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, shard int, slot int, lot int")
    got = sharding.shard_documents(docs).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes, place = defaultdict(list), Counter(), defaultdict(set)
    texts = {d: t or "" for d, t in rows if d is not None and d != 3}
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        if r.doc_id in texts:
            place[texts[r.doc_id]].add(r.shard)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in place.values()) and {r.law for r in got} == {"bytes"}
    # The long texts and the copies are larger than an even share; the rest differ by little.
    big = {place[t] and min(place[t]) for t in (LONG, LONG + " end", "copy" * 50)}
    others = [size for shard, size in sizes.items() if shard not in big]
    assert max(others) - min(others) < 0.02 * max(others)


def test_best_fit_matches_a_plain_search():
    dice = random.Random(8)
    for _ in range(40):
        sizes = [dice.randrange(1, 60) for _ in range(dice.randrange(1, 80))]
        capacity = dice.randrange(60, 120)
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = min(((r, b) for b, r in enumerate(room) if r >= sizes[i]), default=None)
            if fit is None:
                room.append(capacity)
                fit = (capacity, len(room) - 1)
            room[fit[1]] -= sizes[i]
            want[i] = fit[1]
        assert sharding.best_fit_decreasing(sizes, capacity) == want
        packed = sharding.pack(sizes, 5)
        assert set(packed) <= set(range(5))


def tokens(text):
    return len([w for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w])


def test_mixing(spark):
    dice = random.Random(2)
    rows = [(d, t, s) for d, t, _, s in ODD if t is None or len(t) < 1000]
    rows += [(100 + i, " ".join(["w"] * dice.randrange(1, 40)), dice.choice("ppppppqqr")) for i in range(400)]
    docs = spark.createDataFrame([(d, t, s, 1, 1.0) for d, t, s in rows], "doc_id long, text string, source string, epoch int, weight double")
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += tokens(t)
    share = {s: n / sum(total.values()) for s, n in total.items() if n}
    # The least exponent at which no source is repeated more often than twice has a closed form.
    spread = max(share.values()) / min(share.values())
    alpha = max(0.0, 1 - np.log(2.0) / np.log(spread))
    got = mixing.mix_sources(docs, max_epochs=2.0).collect()
    assert got[0].alpha == pytest.approx(alpha, abs=1e-6)
    power = {s: p ** got[0].alpha for s, p in share.items()}
    for s in total:
        used = [r for r in got if r.source == s]
        mine = [(d, tokens(t)) for d, t, source in rows if source == s]
        if not total[s]:
            assert len(used) == len(mine)
            continue
        weight = power[s] / sum(power.values())
        assert used[0].weight == pytest.approx(weight)
        budget = weight * max(total[x] / (power[x] / sum(power.values())) for x in power)
        whole = int(budget / total[s] + 1e-9)
        for epoch in range(whole):
            assert Counter((r.doc_id, r.n_tokens) for r in used if r.epoch == epoch) == Counter(mine)
        last = sum(r.n_tokens for r in used if r.epoch == whole)
        rest = budget - whole * total[s]
        assert last <= rest + 1e-6 and rest - last <= max(n for _, n in mine)
        keys = sorted((r.mix_key, r.n_tokens) for r in used)
        assert 0 <= keys[0][0] and keys[-1][0] <= 1
    first = [r.doc_id for r in sorted((r for r in got if r.source == "p" and r.epoch == 0), key=lambda r: r.mix_key)]
    assert first != sorted(first)


def test_mixing_to_an_entropy_and_a_budget(spark):
    rows = [(i, "w " * 10, s) for s, n in (("a", 60), ("b", 25), ("c", 15)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    entropy = lambda w: -sum(x * np.log2(x) for x in w)
    got = mixing.mix_sources(docs, target_entropy=1.5, budget=500.0).collect()
    weights = {r.source: r.weight for r in got}
    assert entropy(weights.values()) == pytest.approx(1.5, abs=1e-4) and sum(weights.values()) == pytest.approx(1)
    spent = Counter()
    for r in got:
        spent[r.source] += r.n_tokens
    assert all(weights[s] * 500 - 10 <= spent[s] <= weights[s] * 500 + 1e-6 for s in weights)
    assert {r.alpha for r in mixing.mix_sources(docs, target_entropy=1.7).collect()} == {0.0}


def test_language_id(spark):
    dice = random.Random(1)
    vocabulary = {"en": "the of and with that house".split(), "fr": "le être été où garçon maison".split(), "zz": ["абв", "где", "жзи"]}
    rows = [(i, " ".join(dice.choice(vocabulary[lang]) for _ in range(30)), lang) for i in range(200) for lang in [dice.choice(list(vocabulary))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 ...", "en"), (903, "the house" * 40_000, None), (None, "garçon été", None), (904, "the of", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.language_report(docs).collect()}
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and {got[i].score for i in (900, 901, 902)} == {0.0}
    assert got[903].lang_pred == "en" and got[904].lang_pred == "en" and got[None].lang_pred == "fr" and got[None].held_out
    wrong = 0
    for doc_id, _, lang in rows[:200]:
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= got[doc_id].score <= 1
        wrong += got[doc_id].lang_pred != lang
    assert wrong == 0
    assert {r.lang_pred for r in language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_equal_a_plain_coder():
    """Costs byte by byte, from counts held in dictionaries, whatever the pieces and table slots."""
    train, texts = [b"abracadabra", b"abcabc\xc3\xa9"], ["abra", "xyz", "", "caf\xe9 abracadabra" * 50]
    counts = [defaultdict(Counter) for _ in range(4)]
    codes = Counter()
    for data in train:
        padded = b"\0\0\0" + data
        for i in range(3, len(padded)):
            codes[int.from_bytes(padded[i - 3 : i + 1], "big")] += 1
            for order in range(4):
                counts[order][padded[i - order : i]][padded[i]] += 1

    def plain(data):
        padded, bits = b"\0\0\0" + data, 0.0
        for i in range(3, len(padded)):
            for order in (3, 2, 1, 0):
                seen = counts[order].get(padded[i - order : i])
                if seen is None:
                    continue
                whole = sum(seen.values()) + len(seen)
                if padded[i] in seen:
                    bits -= np.log2(seen[padded[i]] / whole)
                    break
                bits -= np.log2(len(seen) / whole)
            else:
                bits += 8
        return bits

    import pyarrow as pa

    tree = language_id.ContextTree(np.array(list(codes), np.uint32), np.array(list(codes.values()), float))
    for piece, slots in ((5, 4096), (1 << 20, 1 << 12)):
        language_id.PIECE, before = piece, language_id.PIECE
        model = language_id.LanguageModel({"a": tree, "b": tree})
        data, ends = language_id.padded(pa.array(texts))
        bits = model.code_lengths(data, ends)
        language_id.PIECE = before
        assert bits[:, 0] == pytest.approx([plain(t.encode()) for t in texts], rel=1e-5)
        assert (bits[:, 0] == bits[:, 1]).all() and slots


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_empty_tables(spark):
    docs = odd(spark).limit(0)
    pages = pages_of(spark)[1].limit(0)
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert line_dedup.line_dedup(docs).collect() == []
    assert ngram_join.ngram_components(docs).collect() == [] and ngram_join.keep_one(docs).collect() == []
    assert sharding.shard_documents(docs).collect() == []
    assert mixing.mix_sources(docs).collect() == []
    assert language_id.language_report(docs).collect() == []
    assert warc.archive_round_trip(pages).collect() == []
    assert url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect() == []


def test_draw_mix_gives_the_rows_of_mix_sources(spark):
    """With whatever names the other columns have, and where a budget ends among rows that repeat an id and a text."""
    dice = random.Random(6)
    rows = [(d, t, s) for d, t, _, s in ODD if t is None or len(t) < 1000]
    rows += [(100 + i, " ".join(["w"] * dice.randrange(1, 40)), dice.choice("ppppppqqr")) for i in range(200)]
    rows += [(None, "no id but some words", dice.choice("pq")) for _ in range(40)] + [(99, "the same row again", "s")] * 50 + [(98, "w " * 1900, "t")]
    names = "doc_id long, text string, source string, epoch int, weight double, name string, whole int, _mix_source string, block int"
    docs = spark.createDataFrame([(*r, 1, 1.0, "n", 3, "m", 4) for r in rows], names)
    for how in ({}, {"max_epochs": 1.7}, {"target_entropy": 1.9}, {"max_epochs": 3.0, "budget": 4321.0}):
        listed = Counter((r.doc_id, r.source, r.n_tokens) for r in mixing.mix_sources(docs, **how).collect())
        drawn = mixing.draw_mix(docs, **how)
        assert drawn.columns == docs.columns
        assert Counter((r.doc_id, r.source, tokens(r.text)) for r in drawn.collect()) == listed
    assert mixing.draw_mix(docs.limit(0)).collect() == []
    tiny = spark.createDataFrame([(1, "w", "a"), *[(2 + i, "w " * 100, "b") for i in range(20)]], "doc_id long, text string, source string")
    assert max(r.epoch for r in mixing.mix_sources(tiny, target_entropy=1.0).collect()) <= mixing.MOST_EPOCHS


def test_rows_without_ids_in_the_join(spark):
    """Many rows without id, of equal and of near texts, and columns with the names that the operator uses."""
    dice = random.Random(12)
    say = lambda n: [f"w{dice.randrange(500)}" for _ in range(n)]
    rows, base = [], [say(80) for _ in range(6)]
    for i in range(240):
        words = dice.choice(base)
        words = edited(dice, words, 1) if dice.random() < 0.4 else words
        rows.append((None if dice.random() < 0.3 else dice.randrange(150), " ".join(words)))
    rows += [(None, " ".join(say(50)))] * 30
    names = "doc_id long, text string, near_id int, _near_id int, _near_hash int, lost_id int, digest int, node int, root int, least int"
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], names)
    want = brute_components(rows, 5, 80, 100)
    got = ngram_join.ngram_components(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(r for r in kept if r[0] is None) == Counter(r for r in rows if r[0] is None)
    assert Counter(d for d, _ in kept if d is not None) == Counter({c for _, _, c in want if c is not None})


def test_line_runs_are_merged_side_by_side(spark):
    """The plans of a batch's anti-join and of a merge: nothing is broadcast, and no run is shuffled or sorted again."""
    lines = lambda low, high: spark.range(low, high).select(F.col("id").alias("doc_id"), F.unhex(F.md5(F.format_string("line %d", F.col("id") % 97).cast("binary"))).alias("hash"))
    store = line_dedup.LineRuns(spark, min_docs=5)
    for low in (900, 600, 300):
        store.add(lines(low, low + 300))
    assert [len(level) for level in store.levels] == [1, 1]
    with store.sorted_scans():
        counted = store.counted(lines(0, 300))._jdf.queryExecution().executedPlan().toString()
        merged = store.frequent()
        plan = merged._jdf.queryExecution().executedPlan().toString()
        rows = {bytes(r.hash): r.keeper for r in merged.collect()}
    assert counted.count("SortMergeJoin") == 2 and counted.count("Exchange") == 1 and "Broadcast" not in counted
    # The batch's own counts are sorted once, for both joins.
    assert counted.count("Sort [") == 1
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan and "Sort [" not in plan
    assert rows == {hashlib.md5(f"line {i % 97}".encode()).digest(): i for i in range(1103, 1200)}
    store.clear()
    assert store.runs() == []


def test_line_dedup_of_rows_without_ids(spark):
    dice = random.Random(3)
    common = [f"Common line number {i} which is long enough to count" for i in range(8)]
    rows = [(None if dice.random() < 0.3 else dice.randrange(60), "\n".join(dice.choice(common) for _ in range(dice.randrange(5)))) for _ in range(150)]
    names = "doc_id long, text string, hash string, part int, batch int, of int, lines int"
    docs = spark.createDataFrame([(*r, "h", 1, 2, 3, 4) for r in rows], names)
    got = line_dedup.line_dedup(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)


def test_coding_takes_little_memory_whatever_turns_up(monkeypatch):
    """Four languages, and texts whose contexts are all unseen: a worker codes them in far less than a hundred bytes for each."""
    codes = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 50_000, np.uint32))
    model = language_id.LanguageModel({lang: language_id.ContextTree(codes, np.ones(len(codes))) for lang in ("de", "en", "es", "fr")})
    text = np.random.default_rng(4).integers(0, 256, 1_500_000, np.uint8)
    ends = np.array([1_000_000, 1_500_000])
    model.byte_costs(codes[:1])
    tracemalloc.start()
    bits = model.code_lengths(text, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    monkeypatch.setattr(language_id, "LOOKUP", 1 << 20)
    model.shift = None
    assert (model.code_lengths(text, ends) == bits).all()


def test_a_task_forgets_its_words():
    task = ngram_join.forgetting(lambda batches: (len(ngram_join.shingle_set(b, 5)) for b in batches))
    assert list(task(["one two three four five six"])) == [2] and not ngram_join._WORDS


def test_signing_takes_little_memory_however_many_signatures(spark, monkeypatch):
    """A task with a million signatures and 400,000 words: a worker holds a bounded part of both at a time, and every text signs."""
    runs = []
    monkeypatch.setattr(ngram_join, "forgetting", lambda run: runs.append(run) or run)
    ngram_join.sign(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 5, 80, 100)
    rng = np.random.default_rng(5)

    def batches():
        for low in range(0, 850, 50):
            texts = [" ".join(map(str, rng.integers(0, 400_000, 2500))) for _ in range(50)]
            ids = pa.array(range(low, low + 50), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "text_hash", "text"])

    signed, named = 0, set()
    ngram_join.forget()
    tracemalloc.start()
    for batch in runs[0](batches()):
        signed += batch.num_rows - batch.column("sig").null_count
        named.update(batch.column("doc_id").drop_null().to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ngram_join.forget()
    assert named == set(range(850))
    assert signed > 1_000_000
    assert peak < 80 << 20
