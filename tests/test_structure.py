"""Structure queries against their SQL on planted documents: the driver's texts have few levels and types of sections."""

import random

import duckdb
import pytest

from foliant.plans import catalogue
from tests.compare import same_rows

TITLES = (
    "1. Objet du marché", "1.2. Portée", "1.2.3. Délais de livraison", "1.2.3.4. Pénalités", "2.1.1.1.1. Annexe technique", "3.1.1.1.1.1.1. Suite",
    "CHAPITRE 4", "chapitre 2", "Section 3", "Article 12", "Introduction", "Conclusion générale:", "Table des matières", "Bibliographie", "Sources",
    "Annexes", "CONDITIONS GÉNÉRALES, VENTE", "الفصل 3", "مقدمة", "TROP COURT.",
)
LINES = (
    "Le transport public relie les communes voisines, et les lignes de transport passent toutes les heures.",
    "Court.", "", "   ", "Les usagers paient leur transport à bord; la carte reste valable deux heures. Est-ce cher? Non!",
    "النقل العمومي يربط بين الجماعات المجاورة، والنقل متاح كل ساعة.", "9 9 9 9 -- ## 12345 67890 *** 24680 13579 .. 11 22 33 44 55 66 77",
    "Une phrase assez longue pour un résumé qui tient en deux cents signes. Une autre phrase, de même longueur ou presque, la suit de près.",
)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(11)
    texts = ["", "court", "\n" * 200, "\n".join(TITLES), "1.1.1. Sans parent\n" * 8, "mot " * 600 + "\n" + "Chapitre 1\n" + "mot " * 600]
    for _ in range(120):
        lines = [draw.choice(TITLES) if draw.random() < 0.4 else draw.choice(LINES) for _ in range(draw.randrange(1, 40))]
        texts.append("\n".join(lines))
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, text, "fr", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["sections", "document_structure", "table_of_contents", "structure_markdown"])
def test_planted_documents(spark, planted, name):
    found = catalogue.queries()[name](spark, planted)
    assert found.count()
    same_rows(found, catalogue.oracle_sql()[name], planted, duckdb.connect())


def test_planted_documents_have_all_kinds(spark, planted):
    rows = catalogue.queries()["sections"](spark, planted).collect()
    assert {r.depth for r in rows} == {1, 2, 3} and {r.level for r in rows} == {1, 2, 3, 4, 5, 6}
    kinds = {"toc", "bibliography", "appendix", "introduction", "conclusion", "chapter", "section", "article", "main_content", "content"}
    assert {r.section_type for r in rows} == kinds
    assert any(r.summary for r in rows) and any(r.keywords for r in rows) and {r.language for r in rows} >= {"french", "arabic", "unknown"}
