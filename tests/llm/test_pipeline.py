"""The pipeline's stages on a planted corpus, each on its own input, and the whole on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_edges import brute_components, tokens

VOCABULARY = {
    "en": "the of and with that house river stone under morning people".split(),
    "fr": "le être été où garçon maison rivière sous matin pierre gens".split(),
}


def planted(spark, tmp_path):
    """Documents (doc_id, text, lang, source, n_chars) and a folder with a benchmark beside them."""
    dice = random.Random(11)
    say = lambda lang, n: " ".join(dice.choice(VOCABULARY[lang]) + dice.choice(["", "s", "x", "ement"]) for _ in range(n))
    items = [(i, say("en", 25)) for i in range(5)]
    rows = []
    for i in range(160):
        lang = dice.choice(["en", "en", "fr"])
        rows.append((i, say(lang, dice.randrange(40, 90)), lang, dice.choice("aaab")))
    words = rows[0][1].split()
    near = [" ".join(w if j != 7 + i else "changed" for j, w in enumerate(words)) for i in range(3)]
    rows += [(200 + i, text, rows[0][2], "b") for i, text in enumerate(near)]
    rows += [(210, rows[5][1], rows[5][2], "a"), (211, rows[5][1].upper(), rows[5][2], "a")]
    rows += [(220 + i, f"{say('en', 20)} {passage} {say('en', 20)}", "en", "a") for i, passage in items]
    rows += [(300, None, "en", "a"), (301, "", None, "a"), (302, "123 456", "en", "b"), (303, "*** !!", None, None)]
    rows += [(310, say("fr", 50), None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return rows, str(tmp_path)


def test_stages(spark, tmp_path):
    rows, folder = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, text = docs.columns, {r[0]: r[1] for r in rows}
    held = {name: stage for name, stage in pipeline.STAGES}
    assert list(held) == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]

    docs = held["language_id"](spark, docs, folder).cache()
    ids = {r.doc_id for r in docs.collect()}
    assert ids == set(text) - {300, 301, 302, 303} and docs.columns == columns

    docs = held["ngram_join"](spark, docs, folder).cache()
    want = {c for _, _, c in brute_components([(i, text[i]) for i in ids], 5, 80, 100)}
    ids = [r.doc_id for r in docs.collect()]
    assert set(ids) == want and len(ids) == len(want) and not want & {200, 201, 202, 210, 211} and docs.columns == columns

    docs = held["decontamination"](spark, docs, folder).cache()
    ids = {r.doc_id for r in docs.collect()}
    assert ids == want - {220, 221, 222, 223, 224} and docs.columns == columns

    docs = held["mixing"](spark, docs, folder).cache()
    used = Counter(r.doc_id for r in docs.collect())
    assert set(used) == ids and max(used.values()) <= 2 and docs.columns == columns
    spent = Counter()
    for r in docs.collect():
        spent[r.source] += tokens(r.text)
    assert spent["a"] == sum(tokens(text[i]) for i in ids if any(r[0] == i and r[3] == "a" for r in rows))

    out = held["sharding"](spark, docs, folder)
    placed = out.collect()
    assert Counter(r.doc_id for r in placed) == used and {"shard", "slot", "text"} <= set(out.columns)
    for shard in {r.shard for r in placed}:
        slots = sorted(r.slot for r in placed if r.shard == shard)
        assert slots == list(range(len(slots)))

    whole = Counter((r.doc_id, r.shard, r.slot) for r in pipeline.run(spark, folder).collect())
    assert whole == Counter((r.doc_id, r.shard, r.slot) for r in placed)


def test_an_empty_table_passes_through(spark, tmp_path):
    planted(spark, tmp_path)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.collect() == []


def test_stages_carry_columns_of_any_name_and_rows_without_ids(spark, tmp_path):
    rows, folder = planted(spark, tmp_path)
    names = "language epoch weight alpha lost_id leaked_id name whole n_tokens mix_key _language _mix_source size shard".split()
    kinds = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names)
    # A tenth of the documents have no id; none of them is a copy or a leak.
    loose = {i for i in range(1, 160, 10) if i != 5}
    rows = [(None if r[0] in loose else r[0], *r[1:]) for r in rows]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], kinds)
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[4:] == names and docs.count() >= (1 if name != "mixing" else before)
        held = {r.text for r in docs.collect() if r.doc_id is None}
        assert held == {text for i, text, *_ in rows if i is None}
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in docs.collect())
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_texts_of_no_learned_language_go(spark):
    dice = random.Random(4)
    say = lambda lang, n: " ".join(dice.choice(VOCABULARY[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i in range(200) for lang in [dice.choice(["en", "fr"])]]
    noise = ["Съешь ещё этих мягких французских булок да выпей чаю", "敏捷的棕色狐狸跳过了懒狗", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ" * 3]
    docs = spark.createDataFrame(rows + [(900 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(range(200))
