"""Leaks against a brute-force comparison of all alignments, with planted exact, edited and partial passages."""

import math
import random
import re
from collections import Counter

from foliant.llm import decontam

WORDS = [f"w{i}" for i in range(400)]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def best_segment(a, b):
    score = run = best = found = 0
    for x, y in zip(a, b, strict=False):
        score = max(0, score + (1 if x == y else -2))
        run = run + (x == y) if score > 0 else 0
        if score > best:
            best, found = score, run
    return found


def brute(docs, items):
    """All pairs that have a common masked window, with the best overlap of such alignments."""
    out = {}
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, passage in items:
            q = tokens(passage)
            found = 0
            for diagonal in range(-len(q), len(d)):
                i0, j0 = max(0, diagonal), max(0, -diagonal)
                n = min(len(d) - i0, len(q) - j0)
                if n < decontam.SPAN:
                    continue
                same = [d[i0 + k] == q[j0 + k] for k in range(n)]
                hit = any(all(same[s + o] for o in mask) for s in range(n - decontam.SPAN + 1) for mask in decontam.MASKS)
                if hit:
                    found = max(found, best_segment(d[i0 : i0 + n], q[j0 : j0 + n]))
            if found >= min(decontam.MIN_MATCHES, math.ceil(len(q) * decontam.MIN_SHARE)) and found:
                key = (doc_id, item_id)
                out[key] = max(found, out.get(key, 0))
    return out


def corpus():
    dice = random.Random(5)
    say = lambda n: " ".join(dice.choice(WORDS) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((11, 14, 14, 30, 60, 200, 5))] + [(7, None), (8, "")]
    docs = [(i, say(dice.randrange(1, 120))) for i in range(30)]
    for i, passage in items[:6]:
        w = passage.split()
        edited = [x if k % 7 != 3 else "other" for k, x in enumerate(w)]
        docs.append((100 + i, f"{say(9)}, {passage.upper()}. {say(7)}"))
        docs.append((200 + i, f"{say(9)} {' '.join(edited)} {say(7)}"))
        docs.append((300 + i, f"{' '.join(w[: len(w) // 2])} {say(20)}"))
        docs.append((400 + i, passage))
    docs += [(900, None), (901, ""), (902, "w1"), (400, "plain " * 40), (None, items[3][1]), (None, "nothing here")]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    rows = [(d, t, "x") for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.find_leaks(frame, bench).collect()}
    assert got == brute(docs, items)
    caught = {d for d, _ in got}
    assert {100 + i for i in range(6)} <= caught and {200 + i for i in range(3, 6)} <= caught
    assert not caught & set(range(30))
    # Rows are judged by their texts: those that share an id with a leaked one, or have none, stay if they are clean.
    leaked = {text for text, _ in brute([(text, text) for _, text in docs], items)}
    kept = Counter((r.doc_id, r.text) for r in decontam.drop_leaks(frame, bench).collect())
    assert kept == Counter((d, text) for d, text in docs if text not in leaked)
    assert kept[(None, "nothing here")] == 1 and kept[(400, "plain " * 40)] == 1 and kept[(None, items[3][1])] == 0


def test_rows_without_ids_and_clashing_columns(spark):
    """A tenth of all rows without id, copies of leaked and clean texts, and columns with the names that the operator uses."""
    dice = random.Random(9)
    say = lambda n: " ".join(dice.choice(WORDS) for _ in range(n))
    items = [(i, say(30)) for i in range(4)] + [(None, say(30)), (2, say(6))]
    texts = [say(60) for _ in range(20)] + [f"{say(10)} {q} {say(10)}" for _, q in items]
    docs = [(None if dice.random() < 0.1 else dice.randrange(60), dice.choice(texts)) for _ in range(200)]
    names = "doc_id long, text string, key string, item_id string, leaked_id string, _leaked string, _LEAKED2 string, words int"
    frame = spark.createDataFrame([(*r, "k", "i", "l", "m", "n", 1) for r in docs], names)
    bench = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, key string")
    leaked = set(texts[20:])
    kept = decontam.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in docs if r[1] not in leaked)
    assert Counter((r.doc_id, r.text) for r in decontam.drop_leaks(frame, bench, max_broadcast=0).collect()) == Counter(r for r in docs if r[1] not in leaked)
    found = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench).collect())
    assert found == Counter((d, items[texts.index(t) - 20][0]) for d, t in {r for r in docs if r[1] in leaked})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontam.find_leaks(none, bench).collect() == []
    assert decontam.find_leaks(some, bench).collect() == []
    assert decontam.drop_leaks(some, bench).count() == 1


def test_short_items_and_unspaced_scripts(spark):
    passage = "日本の首都は東京であり、世界最大の都市圏を形成している"
    items = [(0, "What is the capital of France?"), (1, "zanzibar"), (2, "東京はどこ"), (3, passage), (4, "one two three four five six seven eight nine ten")]
    docs = [
        (10, "q: WHAT is the capital -- of france, a: Paris"),
        (11, "what is the capital of old france"),
        (12, "zanzibar"),
        (13, "zanzibars"),
        (14, "教えて、東京はどこですか"),
        (15, f"前置き{passage}後書き"),
        (16, "zero one two three four five six seven eight nine ten eleven one two three four five six seven eight nine ten"),
        (17, "one two three four five six seven eight nine"),
        (18, "東京 は 京都 より 大きい"),
    ]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.item_words, r.first_word) for r in decontam.find_leaks(frame, bench).collect()}
    n = len(passage) - 1
    assert got == {(10, 0, 6, 6, 1), (12, 1, 1, 1, 0), (14, 2, 5, 5, 3), (15, 3, n, n, 3), (16, 4, 10, 10, 1)}
    assert {r.doc_id for r in decontam.drop_leaks(frame, bench).collect()} == {11, 13, 17, 18}
