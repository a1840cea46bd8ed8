"""Small cases with known results for the analytics functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import classify, entities, language, quality, text
from foliant.operators import documents, metrics, search, sections, summaries


@pytest.fixture
def of(spark):
    def value(column, **fields):
        """A column's value on one row of the given fields."""
        kinds = {str: "string", int: "int", float: "double"}
        names = fields or {"t": ""}
        schema = ", ".join(f"{k} {kinds[type(v)] if type(v) in kinds else v[1]}" for k, v in names.items())
        row = tuple(v if type(v) in kinds else v[0] for v in names.values())
        return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]

    return value


T = None


@pytest.fixture(autouse=True)
def column(spark):
    """``T`` is the field t; a column can't be named before there is a session."""
    global T
    T = F.col("t")


@pytest.mark.parametrize(("given", "want"), [("The table is set.", "en"), ("Le code de la cette ville", "fr")])
def test_language_vote(of, given, want):
    assert of(language.vote(T), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("AAA البحر", "ar"), ("نقل transport الطرق", "mixed"), ("1234 !!", "unknown"), ("abc", "fr")])
def test_french_or_arabic(of, given, want):
    assert of(language.french_or_arabic(T), t=given) == want


def test_detection_of_blank_and_short_texts(of):
    assert of(language.detect_language(T), t="   ").language == "unknown"
    found = of(language.detect_language(T), t="bonjour")
    assert (found.language, found.confidence) == ("french", 1.0)
    assert of(language.detect_language(T), t="في المغرب نقل كل طريق").language == "arabic"
    assert of(language.is_mixed(T), t="abc نقل") and not of(language.is_mixed(T), t="abc")
    assert of(language.simple_language(T), t="123") == "unknown"
    assert of(language.section_language(T), t="نقل transport") == "mixed"
    assert of(language.ocr_language(T, F.lit("نقل")), t="ab") == "arabic"


def test_entities(of):
    fr = F.lit("fr")
    given = "le 3 février 2024, 5 mai 2023 et 12/03/2022"
    assert of(entities.dates(T, fr), t=given) == sorted(["12/03/2022", "février", "2022", "2023", "2024"])
    assert sorted(of(entities.references(T, fr), t="Arrêté n° 12-34 du")) == sorted(["n° 12-34", "Arrêté"])
    assert sorted(of(entities.places(T, fr), t="la région de Fès")) == sorted(["région", "Fès"])
    assert of(entities.persons(T, F.lit("ar")), t="محمد السادس") == ["محمد السادس"]
    assert of(entities.organisations(T, F.lit("ar")), t="وزارة النقل") == ["وزارة النقل"]
    assert of(entities.persons(T, fr), t="محمد السادس") == []


def test_keywords(of):
    given = "pont pont route gare route pont le le le"
    assert of(entities.keywords(T, F.lit("fr")), t=given) == ["pont", "route", "gare"]
    assert of(entities.keywords(T, F.lit("unknown")), t="12") is None
    assert of(entities.metadata_keywords(T), t="Routes et routes, ports") == ["routes", "routes", "ports"]
    assert of(entities.section_keywords(T), t="dans dans mobile mobile mobile durable durable unique " + "x" * 30) == ["mobile", "durable"]


def test_dates(of):
    day = datetime.date
    assert of(entities.parse_date(T), t="03/02/2024") == day(2024, 3, 2)
    assert of(entities.parse_date(T), t="25/02/2024") == day(2024, 2, 25)
    assert of(entities.parse_date(T, dayfirst=True), t="03/02/2024") == day(2024, 2, 3)
    assert of(entities.parse_date(T), t="5 décembre 2020") == day(2020, 12, 5)
    assert of(entities.parse_date(T), t="never") is None
    found = of(entities.typed_dates(T), t=f"approuvé le 01/02/2020 {'x' * 60} effectif dès le 03/04/2021 {'y' * 60} fait le 5 mai 2022 {'z' * 60} le 6 mai 2023")
    assert (found.approval_date, found.effective_date, found.creation_date) == (day(2020, 1, 2), day(2021, 3, 4), day(2022, 5, 5))


def test_document_types(of):
    fr = F.lit("fr")
    found = of(classify.document_type(T, fr), t="Le rapport annuel et le bilan d'activité")
    assert (found.type, found.confidence) == ("rapport", 100.0)
    found = of(classify.document_type(T, fr), t="xyz")
    assert (found.type, found.confidence) == ("cahier_charges", 0.0)
    assert of(classify.sector(T, fr), t="xyz") == "gouvernance"
    assert of(classify.sector(T, fr), t="le navire au port") == "marine_marchande"
    assert of(classify.metadata_type(T), t="xyz") == "regulation"
    assert of(classify.metadata_category(T), t="xyz") == "legal"
    assert of(classify.metadata_department(T), t="xyz") == "transport_routier"
    assert of(classify.status(T), t="version finale") == "final"
    assert of(classify.version(T), t="la Version 2.1 du texte") == "2.1"
    assert of(classify.structure_counters(T)["table_count"], t="الجدول 2") == 2


def test_block_and_paragraph_classes(of):
    size = F.lit(10.0)
    assert of(classify.block_type(T, F.lit(15.0)), t="abc") == "header"
    assert of(classify.block_type(T, size), t="CHAPITRE 3") == "header"
    assert of(classify.block_type(T, size), t="12") == "footer"
    assert of(classify.block_type(T, size), t="• une chose") == "list"
    assert of(classify.block_type(T, size), t="a b c d\na b c d\na b c d") == "table"
    assert of(classify.block_type(T, size), t="Une phrase.") == "body"
    kind = lambda t, style="Normal", level=0: of(classify.paragraph_type(T, F.lit(style), F.lit(level)), t=t)
    assert kind("x", "Heading 1") == "heading" and kind("chapitre 4") == "heading" and kind("- x") == "list_item"
    assert kind("Table des matières") == "toc" and kind("Source: x") == "reference" and kind("Du texte") == "body"


def test_cleaning(of):
    assert of(text.fix_ocr(T, "french"), t="r n") == "m"
    assert of(text.finish_answer(T), t="abcdefghijklmnopqrstuvwxyz" * 2) == "abcdefghijklmnopqrstuvwxyz."
    assert of(text.finish_answer(T), t="Une réponse. et") == "Une réponse."
    assert of(text.sentences(T), t="A b c. D e?! F") == ["A b c", "D e", "F"]
    assert of(text.clean_text(T, "french"), t="Page 3\nUne  phrase , ici\n----\nfin !") == "Une phrase, ici\nfin !"
    assert of(text.clean_text(T, "french"), t="  ") == ""
    assert of(text.fix_encoding(T), t="Ã©tÃ©") == "été"
    assert of(text.normalise_final(T), t="a  \n\n\n\n\nb\t c\r\n") == "a\n\n\nb c\n"
    assert of(text.clean_french(T), t="l' eau d ' ici << mot >>!") == "l'eau d'ici « mot » ! "
    assert of(text.clean_arabic(T), t="و قال") == "وقال"
    assert of(text.fold_arabic(T), t="أإآىئه،ـ") == "ااايية,"
    assert of(text.clean_aggressive(T), t="ok\n.;:!?,..\nune ligne propre") == "une ligne propre"
    assert of(text.drop_ocr_noise(T), t="ab\nune a ligneeeee") == "une   ligne"
    assert of(text.clean_ocr_arabic(T), t="أَحْمَد ة") == "احمد ه"


def test_similarity(of):
    words = lambda s: F.array(*map(F.lit, s.split()))
    assert of(text.jaccard(words("a b c d"), words("a b c e"))) == pytest.approx(0.6)
    kept = text.drop_redundant(F.array(F.lit("a b c"), F.lit("a b c"), F.lit("x y z")), 0.7)
    assert of(kept) == ["a b c", "x y z"]


def test_quality(of, spark):
    assert of(quality.structure_score(T), t="One sentence here. Another one there.") == 0.0
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "Le chat dort dans le jardin. Il fait beau aujourd'hui.")], "doc_id int, text string")
    rows = {r.doc_id: r for r in quality.comprehensive(docs).collect()}
    assert rows[0].processing_status == rows[1].processing_status == "error" and rows[0].overall_score is None
    assert rows[0].issues == ["empty_text"] and rows[2].processing_status == "success" and rows[2].valid
    assert rows[2].overall_score <= 0.73
    found = quality.served_quality(T)
    given = " ".join(["four"] * 10)
    assert of(found["readability_score"], t=given) == 80 and of(found["complexity"], t=given) == "simple"
    assert of(found["quality_rating"], t=given) == "fair"
    assert of(quality.ocr_confidence(T), t="") == 0.0


def test_headings_and_parents(of):
    level = lambda t, lang=None: of(sections.heading_level(T, lang), t=t)
    assert level("hello world") == 1 and level("Éléphant") is None and level("hello, world") is None and level("Ab") is None
    assert level("1.2. Objet") == 3 and level("TEXTE, EN CAPITALES") == 2
    assert of(sections.parents(F.array(*map(F.lit, (1, 2, 3, 2, 3))))) == [-1, -1, 0, -1, 0]
    assert of(sections.depths(F.array(*map(F.lit, (-1, -1, 0, -1, 0))))) == [1, 1, 2, 1, 2]
    assert of(sections.reading_order(F.array(*map(F.lit, (1, 3, 1))), F.array(*map(F.lit, (-1, 0, -1))))) == [0, 2, 1]


def test_sections_cover_a_document(spark):
    body = "Ceci est un paragraphe, assez long pour faire une section. " * 3
    given = f"{body}\n1. Objet du texte\n{body}\n{body}\n2. Fin\ncourt"
    docs = spark.createDataFrame([(1, given), (2, "court"), (3, None)], "doc_id int, text string")
    rows = sections.section_rows(docs).orderBy("doc_id", "ordinal").collect()
    assert [(r.title, r.level, r.start_position, r.end_position) for r in rows] == [
        ("Section 0", 1, 0, 1),
        ("1. Objet du texte", 2, 1, 2),
        ("Section 2", 1, 2, 4),
        ("2. Fin", 2, 4, 5),
        ("court", 1, 5, 6),
    ]
    made = {r.doc_id: r for r in sections.document_structure(docs).collect()}
    assert made[1].total_sections == 5 and made[2].document_type == made[3].document_type == "unknown" and made[2].max_depth == 0
    report = sections.to_markdown(sections.document_structure(docs), sections.section_rows(docs)).collect()
    assert len(report) == 3 and "## Sections" in next(r.markdown for r in report if r.doc_id == 1)
    assert sections.to_html(sections.document_structure(docs), sections.section_rows(docs)).count() == 3


def test_search(of):
    assert of(search.search_score(T, "le  chat"), t="le chien") == 20
    assert of(search.search_score(T, "Le Chien", "exact"), t="le chien") == 100
    assert of(search.snippet(T, "mot"), t="x" * 150 + "mot" + "y" * 150) == "..." + "x" * 100 + "mot" + "y" * 100 + "..."
    answer = search.chat_answer(T, F.lit("a.txt"), F.lit("bref"), F.lit(3), F.lit("fr"))
    assert of(answer, t="un résumé") == 'Voici un résumé du document "a.txt": bref'
    assert of(answer, t="combien de mots") == 'Le document "a.txt" contient 3 mots et est en fr.'


@pytest.mark.parametrize("given", ["", "abc", "mot " * 1000, "x" * 5000, "para un.\n\n" * 300, "a\n" * 2000])
def test_recursive_chunks_are_bounded_and_whole(given):
    chunks = search.split_recursively(given, 1000, 200)
    assert all(len(c) <= 1000 for c in chunks)
    assert set(given.split()) <= set(" ".join(chunks).split()) or "x" * 1000 in chunks


def test_tables_and_sizes(of):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert of(documents.table_text(rows)) == "[TABLE]\n| a | b |\n| --- | --- |\n| c |  |\n[/TABLE]\n"
    assert of(documents.table_text(rows, False)) == "a\tb\nc\t"
    size = lambda n: of(documents.human_size(F.lit(n)))
    assert (size(1536), size(5242880), size(0)) == ("1.5 KB", "5.0 MB", "0 B")
    merged = documents.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("")))
    assert of(merged) == {"a": "1", "b": ""}
    fields = documents.map_properties(F.create_map(F.lit("author"), F.lit("x"), F.lit("creator"), F.lit("y"), F.lit("title"), F.lit("")))
    assert of(fields["author"]) == "y" and of(fields["title"]) is None
    pages = F.array(F.struct(F.lit(1).alias("number"), F.lit("a").alias("text")))
    assert of(documents.pages_text(pages)) == "\n--- Page 1 ---\na"
    blocks = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("type")) for t, k in (("b", "body"), ("h", "header"), ("f", "footer"))])
    assert of(documents.page_text(blocks)) == "# h\n\nb"
    assert of(documents.extraction_status(F.lit(0.9))) == "success"


def test_metrics(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("cpu_usage", at(i), float(v)) for i, v in enumerate((1, 2, 3, 4, 100))]
    points = spark.createDataFrame(rows, "name string, ts timestamp, value double")
    got = metrics.summary(points).first()
    assert (got["mean"], got["median"], got["last_value"]) == (22, 3, 100)
    assert got["std"] == pytest.approx(39.012818) and got["p95"] == pytest.approx(80.8) and got["p99"] == pytest.approx(96.16)
    totals = metrics.running_counter(points.where("value < 4"), "ts").orderBy("ts").collect()
    assert [r.total for r in totals] == [1, 3, 6]
    breaches = spark.createDataFrame([("cpu_usage", "warning", at(s)) for s in (0, 100, 299, 301, 500, 602)], "name string, level string, ts timestamp")
    assert [r.ts for r in metrics.cooled_down(breaches).orderBy("ts").collect()] == [at(0), at(301), at(602)]
    alerts = spark.createDataFrame([(at(i), i >= 5) for i in range(25)], "ts timestamp, resolved boolean")
    assert metrics.recent_alerts(alerts).count() == 0
    found = metrics.breaches(points, metrics.rules_frame(spark)).collect()
    assert len(found) == 5 and found[0].message.endswith("%")


def test_summaries(spark, of):
    assert of(summaries.first_sentences(T), t="Court. Une phrase assez longue. Encore une autre phrase.") == "Une phrase assez longue. Encore une autre phrase."
    assert of(summaries.first_sentences(T), t="") == "Aucun contenu significatif trouvé."
    docs = spark.createDataFrame([("Le chat dort ici bien. " * 3 + "Une autre phrase est là aussi. Le chien court très vite dehors.",), ("Peu.",), (None,)], "text string")
    rows = [r.summary for r in summaries.textrank(docs, 2).collect()]
    assert rows[1:] == ["Peu.", None] and len(rows[0]) < 120
    assert of(summaries.summary_quality(F.lit(1.0), T, T), t="a b c") == pytest.approx(0.86)


def test_analysis_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "1234 !!"), (2, None), (3, "Le ministre et le navire")], "doc_id int, text string")
    rows = {r.doc_id: r for r in documents.analyse(docs).collect()}
    assert rows[1].processing_status == "error" and rows[1].mots_cles is None
    assert rows[3].processing_status == "success" and rows[3].mots_cles == ["ministre", "navire"]
    report = documents.analyse(docs.where("doc_id = 3")).select(documents.report_text().alias("r")).first().r
    assert "Langue: Français" in report and "• ministre" in report
    assert documents.metadata(docs).count() == 3


def test_a_lexicon_in_blocks_gives_the_same_classes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "la route et le port"), (2, "port port route"), (3, "rien")], "doc_id long, text string")
    terms = [("sea", 0, "Port", 1), ("land", 1, "route", 1), ("land", 1, "rail", 2), ("sea", 0, "navire", 1)]
    lexicon = spark.createDataFrame(terms, "class string, ord int, term string, weight int")
    whole = sorted(classify.classify_with(docs, lexicon).collect())
    assert [tuple(r) for r in whole] == [(1, "sea", 1.0), (2, "sea", 2.0)]
    monkeypatch.setattr(classify, "TERM_BLOCK", 1)
    assert sorted(classify.classify_with(docs, lexicon).collect()) == whole
