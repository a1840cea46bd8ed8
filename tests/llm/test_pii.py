"""The base detectors against Python's regular expressions, and the information-theoretic step on a planted corpus."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), rank, m.end()))
    return sorted(spans)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = brute(text)
        coded = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(coded.encode()).hexdigest(), (text, coded, got[i])
        for rank, kind in enumerate(pii.KINDS[:4]):
            assert got[i][f"n_{kind}"] == sum(1 for s in spans if s[1] == rank)
        assert set(filter(None, coded.split(","))) <= set(got[i].spans.split(","))
    return got


def test_base_spans(spark):
    check(
        spark,
        [
            None,
            "",
            "a@b.c@d.e x@y.com_z@w.org .@d.e é🙂 q%+-@a-b.c.d. a@@b.c",
            "1.2.3.4.5.6.7.8 300.1.1.1.1 0001.2.3.255 1.2.3 256.1.1.1 1.2.3.4",
            "4137894711755904 4111 1111 1111 1111 4111-1111-1111-1111, 1234567890123456 49927398716 0000 0000 0000 0000 00000",
            "é +1 (743) 555-3824 +12 +1234567890123456 +44 20 7946 0958.",
            "+4111111111111111 41111111111111114111111111111111",
            "4111 1111 1111 1111-" * 3,
            "x" * 30000 + "@" + "a." * 9000 + "b",
            "1" * 30000,
            "a@b.co " * 1500,
        ],
    )


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aZ0145@.+-% ()é🙂\n", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    check(spark, texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_report(docs).collect() == []


def test_a_term_that_gives_an_entity_away_is_sanitised(spark):
    planted = [f"note {w} Zanzibarine a@b.org {w}{w} end" for w in ("one", "two", "three", "four")]
    plain = [f"plain words only here {w} two one" for w in "abcdefghijklmnopqrstuvw"]
    docs = spark.createDataFrame(list(enumerate(planted + plain)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i in range(4):
        assert "Zanzibarine" not in rows[i].clean_text and "[TERM]" in rows[i].clean_text and "[EMAIL]" in rows[i].clean_text
    for i in range(4, len(planted + plain)):
        assert rows[i].clean_text == plain[i - 4] and not rows[i].spans


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "the rarest words beside a@b.org stay as they are") for i in range(9)], "doc_id long, text string")
    assert {r.n_term for r in pii.sanitise(docs).collect()} == {0}


def test_a_term_far_from_its_entity_is_sanitised_wherever_it_stands(spark):
    far = "Zanzibarine K7 {} " + "plain words only here " * 5 + "a@b.org and Zanzibarine again"
    planted = [far.format(w) for w in ("uno", "dos", "tres", "quatro")] + ["only Zanzibarine is named here"]
    plain = [f"plain words only here and again is named {w}" for w in "abcdefghijklmnopqrstuvw"]
    docs = spark.createDataFrame(list(enumerate(planted + plain)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for i in range(4):
        want = planted[i].replace("Zanzibarine", "[TERM]").replace("K7", "[TERM]").replace("a@b.org", "[EMAIL]")
        assert rows[i].clean_text == want and rows[i].n_term == 3
    assert rows[4].clean_text == "only [TERM] is named here"
    for i in range(5, len(planted + plain)):
        assert rows[i].clean_text == plain[i - 5] and not rows[i].spans


def test_a_word_that_mostly_stands_without_its_entity_stays_there(spark):
    planted = [f"{w} with Zanzibarine a@b.org" for w in ("uno", "dos", "tres", "quatro")]
    named = [f"{w} Zanzibarine" for w in ("cinco", "seis", "siete", "ocho", "nueve")]
    plain = [f"plain with uno dos tres {i}" for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(planted + named + plain)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert all(rows[i].clean_text.endswith("with [TERM] [EMAIL]") for i in range(4))
    assert all(rows[4 + i].clean_text == text for i, text in enumerate(named + plain))


def terms_of(text):
    """The terms of a text, with the spans of each, outside the base spans."""
    blank = list(text or "")
    for a, _, b in brute(text):
        blank[a:b] = " " * (b - a)
    out = defaultdict(list)
    for m in re.finditer(r"[^\W_]+", "".join(blank)):
        word = m[0].lower()
        out[word].append((m.start(), 4, m.end()))
        if len(word) >= pii.SHAPE_LEAST and re.search("[0-9]", word):
            made_of = "digits" if re.fullmatch("[0-9]+", word) else "hex" if re.fullmatch("[0-9a-f]+", word) else "mixed"
            out[f"#{made_of}{len(word)}"].append((m.start(), 4, m.end()))
    return out


def entities_of(text):
    out = set()
    for a, rank, b in brute(text):
        value = text[a:b].lower()
        out.add(f"{pii.KINDS[rank]}:{value}")
        if rank == 0:
            out |= {"local:" + value.split("@")[0], "domain:" + value.split("@")[1]}
        elif rank == 1:
            out.add("net:" + value.rpartition(".")[0])
        elif rank == 3:
            out.add("exchange:" + re.sub("[^0-9]", "", value)[:7])
    return out | {"about:" + w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w in pii.PROTECTED}


def recount(texts):
    """All spans of each text, by counting every pair of an entity and a term."""
    rows = [(t or "", entities_of(t), terms_of(t)) for t in texts]
    n_entity, n_term = Counter(e for _, es, _ in rows for e in es), Counter(w for _, _, ws in rows for w in ws)
    both, together = Counter(), defaultdict(set)
    for text, es, ws in rows:
        for e in es:
            for w in ws:
                if e.startswith("about:") <= w.startswith("#"):
                    both[e, w] += 1
                    together[e, w].add(text)
    reveals, alone = defaultdict(set), set()
    for (e, w), n in both.items():
        ic = math.log(len(rows) / n_entity[e])
        if len(together[e, w]) >= 3 and ic > 0 and math.log(n * len(rows) / (n_entity[e] * n_term[w])) >= 0.8 * ic - 1e-12:
            reveals[e].add(w)
            if 2 * n > n_term[w]:
                alone.add(w)
    out = []
    for text, es, ws in rows:
        held = {w for w in ws if w in alone or any(w in reveals[e] for e in es)}
        out.append(sorted(set(brute(text)) | {span for w in held for span in ws[w]}))
    return out


def test_all_spans_equal_a_recount(spark):
    """Disclosures planted among random texts; at least nine in ten of them, and no other text's, are found."""
    dice = random.Random(21)
    prose = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    say = lambda n: " ".join(dice.choice(prose) for _ in range(n))
    people = [(f"Person{c}", f"{c}@{c}mail.org", f"+1 (212) 555-0{i}12") for i, c in enumerate("abcdefgh")]
    texts, planted = [], []
    for name, mail, phone in people:
        for i in range(5):
            planted.append(len(texts))
            texts.append(f"{say(9)} {name} {say(4)} {mail if i % 2 else mail.replace('@', str(i) + '@')} {say(6)} {phone}")
    for _ in range(12):
        planted.append(len(texts))
        texts.append(f"{say(12)} token = {dice.getrandbits(128):032x} {say(5)}")
    texts += [say(dice.randrange(3, 30)) for _ in range(600)]
    texts += ["the token of esteem", f"{say(5)} {dice.getrandbits(128):032x}", f"{people[0][0]} alone", None, "", "4111 1111 1111 1111@x.com é" * 2]
    texts += [texts[0]] * 4 + [texts[60]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    want = recount(texts)
    for i, spans in enumerate(want):
        assert got[i].spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans), (i, texts[i])
        assert got[i].n_spans == len(spans) and got[i].n_term == sum(k == 4 for _, k, _ in spans)
    caught = sum(got[i].n_term > 0 for i in planted)
    assert caught >= 0.9 * len(planted)
    assert not any(got[i].n_spans for i in range(52, 652)) and got[653].n_term == 1


def test_terms_are_found_in_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    secret = re.compile('token = "([0-9a-f]{40})"')
    held = {r.doc_id: {m.span(1) for m in secret.finditer(r.text or "")} for r in docs.collect()}
    for doc_id, spans in held.items():
        assert all(f"term:{a}:{b}" in rows[doc_id].spans.split(",") for a, b in spans)
    assert sum(r.n_term for r in rows.values()) > 0 and any(held.values())


def test_very_many_matches(spark):
    text = "a@b.co, 1.2.3.4, 4111111111111111, +1 (212) 555-0123, word é " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = pii.sanitise(docs).collect()
    took = time.perf_counter() - began
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (10_000,) * 4
    assert row.clean_text == "[EMAIL], [IP], [CARD], [PHONE], word é " * 10_000
    assert took < 60, took
