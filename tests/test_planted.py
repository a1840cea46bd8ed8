"""Quality and cleaning queries against their SQL on planted texts: the driver's have few of the faults that these look for."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.plans import catalogue
from foliant.plans.registry import r6
from tests.compare import same_rows

GOOD = "Le marché public couvre les travaux de la route nationale. Les offres sont remises avant la date fixée. La commission ouvre les plis en séance publique."
FAULTS = (
    "a b c d e f g h i j k l m n o p", "un de la le si ou et il tu ne se ce", "mot     espacé      beaucoup", "page 12 © 2020, 3/14", "| | cellule |\t\t\t\tvide",
    "•• - *\n-- puce", "caractÃ©re cassÃ¡ â€™ ici", "Il1 ll| 1I rn vv OO 0O0", "sigleSNCF et motMajuscule dansLaPhrase", "ABC suivi de DEF puis GHI",
    "http://a.fr http://b.fr http://c.fr", "aaaaaa bbbb!!!!! cccccccc ....... éééééé", "x y 7 é — « » …", "12ab c3po r2d2 4x4 99z", "1234567890 9876 %%% $$$ ###",
    "THE SAME LINE. The same line. the same line! The very same line, the same line.", "و قال النقل العمومي. هل وصل؟", "Voici l' arrêté d 'un maire , qu' il signe:<< texte >>ici;A. B.C dit !Oui", "....\n---\n| | |\n+-|\n===\n!!!! a.\n____",
    "Première partie.\n\nDeuxième partie.",
    "Texte adopté le 14/07/2021 par le conseil, avec une entrée en vigueur au 3 février 2022 ou au 05.06.2022; fait le 02-11-2020.",
    "Le 31/31/2020 n'est pas une date, le 30 février 2021 non plus; approuvé le 12 DÉCEMBRE 2019 puis le 1 mars 2020.",
    "Transport routier: transports, routes, véhicules et autoroutes; la sécurité du transport, la réglementation, le port et la gare. Le marché, le marché, le marché.",
)
QUERIES = ["comprehensive_quality", "source_specific_quality", "ocr_clean", "greedy_dedup", "metadata", "analysis", "clean_standard", "line_filters", "clean_french", "clean_arabic"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(5)
    texts = ["", " ", "court", "a", GOOD, GOOD + "\n\n" + GOOD, *FAULTS]
    for _ in range(150):
        parts = [draw.choice(FAULTS) if draw.random() < 0.5 else draw.choice(GOOD.split(". ")) for _ in range(draw.randrange(1, 12))]
        texts.append(draw.choice(["\n", ". ", "\n\n", " "]).join(parts))
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, text, "fr", "web", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_planted_texts(spark, planted, name):
    same_rows(catalogue.queries()[name](spark, planted), catalogue.oracle_sql()[name], planted, duckdb.connect())


def test_planted_texts_have_the_faults(spark, planted):
    rows = catalogue.queries()["comprehensive_quality"](spark, planted).collect()
    found = {x for r in rows for x in r.all_issues.split("|")}
    assert found >= {"broken_words", "encoding_issues", "excessive_whitespace", "header_footer_artifacts", "table_artifacts", "formatting_artifacts", "empty_text"}
    assert {r.processing_status for r in rows} == {"error", "success"} and any(r.extraction_score for r in rows)
    rows = catalogue.queries()["source_specific_quality"](spark, planted).collect()
    assert {x for r in rows for x in r.pdf_issues.split("|")} == {"", "column_merge_issues", "font_size_artifacts", "excessive_hyperlinks"}
    assert len({x for r in rows for x in r.ocr_issues.split("|")}) == 7
    rows = catalogue.queries()["metadata"](spark, planted).collect()
    assert all(len({r[c] for r in rows}) > 1 for c in ("approval_date", "effective_date", "text_creation_date", "keywords"))
    rows = catalogue.queries()["greedy_dedup"](spark, planted).collect()
    assert any(r.n_kept < r.n_sentences for r in rows)


@pytest.mark.parametrize("name", ["comprehensive_quality", "readability_score", "basic_quality"])
def test_scores_halfway_between_two_millionths(spark, tmp_path, name):
    """Of 128 or 640 words the most frequent one takes a share whose fifth has a 5 at the seventh place."""
    texts = []
    for n in (128, 640):
        for top in range(1, 60):
            ws = ["le"] * top + [("été" if i % 9 == 0 else "mot") + "".join(chr(97 + int(d)) for d in str(i)) for i in range(n - top)]
            texts.append(". ".join(" ".join(ws[i : i + 5 + top % 13]) for i in range(0, n, 5 + top % 13)) + "." + "\n\n" * (top % 2) + "  |  |" * (top % 3))
    rows = [(i, text, "fr", "web", len(text)) for i, text in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    same_rows(catalogue.queries()[name](spark, folder), catalogue.oracle_sql()[name], folder, duckdb.connect())


def test_rounding_is_that_of_the_sql(spark):
    draw = random.Random(6)
    values = [draw.randrange(1, 20_000_000) / 1e7 for _ in range(3000)] + [draw.randrange(5, 10**7, 10) / 1e7 + draw.choice((-1, 1)) * 2.0**-53 for _ in range(3000)]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").orderBy("i").select(r6(F.col("v")).alias("x")).collect()]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (i BIGINT, v DOUBLE)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert got == [x for (x,) in connection.sql("SELECT round(v, 6) FROM t ORDER BY i").fetchall()]
