import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm.quality import PUBLISHED, RUNNING, failed_rules, figures, text_figures

PROSE = "The committee has asked for a report on the state of the roads, and we shall have it in time. Nobody here is surprised by that."
GERMAN = "Der Ausschuss hat über die Lage der Straßen beraten, und wir werden den Bericht in diesem Jahr noch sehen."
FRENCH = "Le ministère n'a pas encore répondu, mais nous savons que la commission est d'accord avec le rapport de l'inspecteur."
ITEMS = ["- road repairs on the islands", "- water meters in the outer districts;", "- care budgets for those on low incomes", "- hospital wards outside the capital"]


def figure(text):
    return {k: v[0] for k, v in figures(pa.array([text], pa.string())).items()}


def test_figures_by_hand():
    f = figure("The cat sat.\n\n- 12 “dogs” ran ...\n* x" + chr(0xAD) + "y # end!")
    assert f["n_words"] == 12 and f["n_lines"] == 3
    assert f["mean_word_length"] == pytest.approx(33 / 12)
    assert f["symbol_ratio"] == pytest.approx(2 / 12)
    assert f["letter_word_share"] == pytest.approx(7 / 12)
    assert f["common_word_share"] == pytest.approx(1 / 12)
    assert f["final_punctuation_share"] == 1 and f["ellipsis_line_share"] == pytest.approx(1 / 3)
    assert f["bullet_line_share"] == pytest.approx(2 / 3) and f["item_word_share"] == 0
    assert f["top_word_share"] == pytest.approx(4 / 12)  # words without a letter or digit are one


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_nothing(text):
    assert not any(figure(text).values())


def cases(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    rows = text_figures(frame, "doc_id").withColumns({"running": failed_rules(RUNNING), "published": failed_rules(PUBLISHED)}).collect()
    return {r["doc_id"]: r for r in rows}


def test_rules(spark):
    prose = [PROSE, GERMAN, FRENCH, PROSE.lower().replace(".", "").replace(",", ""), PROSE.upper(), PROSE.replace(" ", "\n"), "\n".join(f"- {p}" for p in (PROSE, GERMAN)), PROSE + "\n" + ITEMS[0] + "\n" + ITEMS[1], "I call the next speaker.", "ROADS BILL\n\nAmendment, by leave, withdrawn.", "", None]
    bad = ["Members\nContact us\nShare\nArchive\nContact us\nBack to top\nContact us\nShare\nLog in\nArchive\nBack to top\nShare\nContact us\nLog in", "\n".join(ITEMS), "a | 1 | 2\nb | 3 | 4\nc | 5 | 6\nd | 7 | 8", "the " * 50, "qz;x |~ _o <1> ^k *f ;; p\\ q|" * 5, "Home › Log in › Search › Help › Share › RSS › Home › Log in", "QUJDREVGR0hJSktMTU5PUA==" * 4, "a. die Lage der Straßen\nb. der Schutz der Küste\nc. la réforme des ports\ni. le prix de l'eau"]
    found = cases(spark, prose + bad)
    for i in range(len(prose)):
        assert found[i]["running"] == [], (prose[i], found[i])
    for i in range(len(prose), len(prose) + len(bad)):
        assert found[i]["running"], (bad[i - len(prose)], found[i])
    assert "word_count" in found[0]["published"] and "bullet_lines" in found[len(prose) + 1]["published"]


@pytest.mark.parametrize("folder", ["sf0.1", "check_l"])
def test_labelled_samples(spark, small, folder):
    """The first sample was looked at when the thresholds were set; the other one, of other rows, never was."""
    folder = small.replace("sf0.001", folder)
    if not os.path.isdir(folder):
        pytest.skip("no such tables here")
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet").where("label IS NOT NULL").dropDuplicates(["doc_id"])
    documents = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id")
    figures = text_figures(documents.select("doc_id", "text"), "doc_id").join(labels, "doc_id")
    for rules, right, wrong in ((RUNNING, 0.99, 0.01), (PUBLISHED, 0.95, 4)):
        counts = figures.groupBy((F.col("label") == "prose").alias("prose"), (F.size(failed_rules(rules)) > 0).alias("failed")).count().collect()
        n = {(r["prose"], r["failed"]): r["count"] for r in counts}
        bad = n[False, True] + n.get((False, False), 0)
        assert n[False, True] >= right * bad and n.get((True, True), 0) <= wrong * bad


def test_repeated_empty_and_very_long(spark):
    frame = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, "the cat " * 700_000)], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["n_words"]) for r in text_figures(frame, "doc_id").collect())
    assert rows == [(1, 26), (1, 26), (2, 1_400_000)]
    assert text_figures(frame.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        text_figures(frame.withColumnRenamed("doc_id", "n_lines"), "n_lines")
