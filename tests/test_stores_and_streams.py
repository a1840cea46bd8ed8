"""Sources, sinks, adapters and streams on small folders."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import models
from foliant.sources import files, sinks
from foliant.streaming import metrics as streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, title="Titre"):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        archive.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return held.getvalue()


def paragraph(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


@pytest.fixture
def folder(tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + paragraph("a") + "</w:tc><w:tc>" + paragraph("b") + "</w:tc></w:tr></w:tbl>"
    (tmp_path / "good.docx").write_bytes(docx(paragraph("Objet", "Heading2") + paragraph("- point") + paragraph("Du texte " * 20) + table))
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "odd.pdf").write_bytes(b"x")
    (tmp_path / "real.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "note.txt").write_text("ligne un\nligne deux", encoding="utf-8")
    return str(tmp_path)


def test_listing_validation_and_info(spark, folder):
    found = files.validate(files.find_files(spark, folder, extensions=(".docx", ".pdf", ".txt")))
    rows = {r["name"]: r for r in found.drop("content").collect()}
    assert rows["good.docx"].is_valid and rows["real.pdf"].is_valid and rows["good.docx"].reader == "word"
    assert rows["odd.pdf"].errors == ["Invalid PDF file"] and rows["bad.docx"].errors == ["Invalid DOCX file"]
    assert rows["note.txt"].errors == ["Unsupported file extension: .txt"]
    info = {r["name"]: r for r in files.file_info(files.find_files(spark, folder)).collect()}
    assert info["real.pdf"].stem == "real" and info["real.pdf"].size_human == "10.0 B" and len(info["real.pdf"].hash_md5) == 32
    texts = files.read_texts(spark, folder).collect()
    assert [(t.text, t.filename) for t in texts] == [("ligne un\nligne deux", "note.txt")]


def test_word_documents(spark, folder):
    rows = {r.path.rpartition("/")[2]: r for r in files.read_docx(files.find_files(spark, folder, "*.docx")).collect()}
    good = rows["good.docx"]
    assert good.text.startswith("## Objet\n\n• - point\nDu texte") and "| a | b |" in good.text
    assert (good.headings, good.lists, good.tables, good.status) == (1, 1, 1, "success") and good.properties["title"] == "Titre"
    assert rows["bad.docx"].error and rows["bad.docx"].status == "failed"


def test_readers_and_user_functions_keep_errors_to_their_row(spark, folder):
    every = files.find_files(spark, folder, "*.pdf")
    assert {bool(r.error) for r in files.read_with(every, "pdf", files.NoReader).collect()} == {True}

    class Upper:
        def read(self, path, content):
            return {"text": content.decode().upper(), "metadata": {"pages": "1"}}

    models.register_model("upper", Upper)
    got = {r.path.rpartition("/")[2]: r for r in files.read_with(every, "upper", files.NoReader).collect()}
    assert got["real.pdf"].text == "%PDF-1.4 X" and got["real.pdf"].metadata == {"pages": "1"}

    def first(path, content):
        return chr(content[1])

    rows = {r.path.rpartition("/")[2]: r for r in models.run_each(every, first).collect()}
    assert rows["real.pdf"].result == "P" and not rows["odd.pdf"].success and "index" in rows["odd.pdf"].error


def test_adapters_have_fallbacks(spark):
    docs = spark.createDataFrame([("un deux trois",), (None,)], "text string")
    vectors = [r.embedding for r in models.embed(docs).collect()]
    assert len(vectors[0]) == 256 and sum(x * x for x in vectors[0]) == pytest.approx(1, abs=1e-5)
    assert [r.summary for r in models.summarise(docs, 2).collect()] == ["un deux", None]
    assert models.find_entities(docs).first().entities == []
    spans = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("size"), F.lit(f).alias("font")) for t, s, f in (("A", 10.0, "x"), ("B", 20.0, "x"))])
    block = spark.range(1).select(files.text_blocks(F.array(spans)).alias("b")).first().b[0]
    assert (block.text, block.font_size, block.font, block.type) == ("AB", 15.0, "x", "header")
    assert spark.range(1).select(files.mean_confidence(F.array(F.lit(90), F.lit(-1), F.lit(70))).alias("c")).first().c == 80


def test_manifests(spark, folder, tmp_path):
    manifest = sinks.create_manifest(files.validate(files.find_files(spark, folder, "*.docx")))
    path = manifest.where("path LIKE '%good%'").first().path
    results = spark.createDataFrame([(path, 1.5, ["out"])], "path string, processing_time double, output_files array<string>")
    updated = sinks.update_manifest(manifest, results)
    assert {(r.path == path, r.processed, r.processing_time) for r in updated.collect()} == {(True, True, 1.5), (False, False, 0.0)}
    sinks.write_json(updated, f"{tmp_path}/manifest")
    assert files.read_manifest(spark, f"{tmp_path}/manifest").where("processed").count() == 1


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é", "success"), (2, None, "error")], "doc_id int, title string, processing_status string")
    made = {r.doc_id: r.json for r in sinks.analysis_json(docs).collect()}
    assert json.loads(made[1]) == {"title": "é", "processing_status": "success"} and "é" in made[1]
    sinks.write_batch(docs, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/batch_info").first().success_rate == 50
    xml = docs.select(sinks.to_xml({"title": F.col("title"), "tags": sinks.xml_items(F.array(F.lit("a"), F.lit("b")))}).alias("x")).collect()
    assert xml[0].x.endswith("<title>é</title><tags><item>a</item><item>b</item></tags></document_metadata>") and "<title>None</title>" in xml[1].x


def test_registry(spark, tmp_path):
    registry = sinks.DocumentRegistry(spark, f"file://{tmp_path}/registry")
    now = datetime.datetime(2024, 1, 1)
    new = lambda i, name: spark.createDataFrame([(i, name, "t", "fr", 1, now)], registry.SCHEMA)
    assert registry.all().count() == 0
    assert registry.add(new("1", "a.txt")).count() == 0
    registry.add(new("2", "b.txt"))
    registry.add(new("3", "a.txt"))
    assert {r.id for r in registry.listing().collect()} == {"1", "2"} and registry.get("2").first().filename == "b.txt"
    assert registry.delete("1") and not registry.delete("1") and registry.health().first().documents_count == 1


def test_vector_store(spark, tmp_path):
    store = sinks.VectorStore(spark, f"file://{tmp_path}/vectors")
    docs = spark.createDataFrame([("1", "le chat dort", {"k": "v"}), ("2", "le navire part", None)], "doc_id string, text string, metadata map<string,string>")
    store.add_documents(docs)
    queries = spark.createDataFrame([("q", "le chat dort")], "query_id string, question string")
    best = store.search(queries, k=1).first()
    assert store.count() == 2 and best.chunk == "le chat dort" and best.similarity == pytest.approx(1, abs=1e-5) and best.metadata == {"k": "v"}


def test_streams(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    points = [("cpu_usage", at(s), 0.95) for s in (0, 100, 299, 301, 500, 602)] + [("other", at(s), 1.0) for s in (1, 2, 3)]
    frame = spark.createDataFrame(points, "name string, ts timestamp, value double")
    folder = f"{tmp_path}/in"
    for part in (frame.where("ts < '2024-01-01 00:04:00'"), frame.where("ts >= '2024-01-01 00:04:00'")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: streams.points_stream(spark, folder, maxFilesPerTrigger=1)
    streams.run_once(streams.counters(stream()), f"{tmp_path}/c", f"{tmp_path}/c-check")
    totals = spark.read.parquet(f"{tmp_path}/c").where("name = 'other'").orderBy("ts").collect()
    assert [r.total for r in totals] == [1, 2, 3]
    streams.run_once(streams.alerts(stream()), f"{tmp_path}/a", f"{tmp_path}/a-check")
    assert [r.ts for r in spark.read.parquet(f"{tmp_path}/a").orderBy("ts").collect()] == [at(0), at(301), at(602)]
    streams.run_once(streams.window_stats(stream(), "5 minutes"), f"{tmp_path}/w", f"{tmp_path}/w-check", "complete")
    assert {(r["name"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {("cpu_usage", 3), ("cpu_usage", 2), ("cpu_usage", 1), ("other", 3)}
    seen = []
    query = streams.run_callbacks(streams.alerts(stream()), [seen.append, lambda row: 1 / 0], f"{tmp_path}/cb", "1 second")
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 3


def test_registry_returns_all_that_it_turns_away(spark, tmp_path):
    """Of new rows with one name the earliest is stored; later ones, exact repeats and known names come back."""
    registry = sinks.DocumentRegistry(spark, f"file://{tmp_path}/repeats")
    at = lambda day: datetime.datetime(2024, 1, day)
    rows = [("2", "a", "t", "fr", 1, at(2)), ("1", "a", "t", "fr", 1, at(1)), ("1", "a", "t", "fr", 1, at(1)), ("3", "b", "t", "fr", 1, at(1))]
    away = registry.add(spark.createDataFrame(rows, registry.SCHEMA))
    assert sorted(r.id for r in away.collect()) == ["1", "2"]
    assert sorted((r.id, r.filename) for r in registry.listing().collect()) == [("1", "a"), ("3", "b")]
    assert registry.add(spark.createDataFrame(rows[:1], registry.SCHEMA)).count() == 1 and registry.all().count() == 2
