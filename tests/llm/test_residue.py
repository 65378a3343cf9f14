"""Residue: what decides, wordings not seen before, hosts."""

import residue_wordings as W
from pyspark.sql import functions as F

from termweave.llm import residue

SCHEMA = "doc bigint, text string, title string, slug string, host string"
REAL = "Blood pressure fell by 4 mmHg in 120 adults after 12 weeks of walking. Two nurses kept the charts."


def _found(spark, texts, title=None, host="h"):
    df = spark.createDataFrame([(i, t, title, None, host) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc"]: r["kind"] for r in residue.residue(df).collect()}


def test_wordings(spark):
    held, tuned = _found(spark, W.HELD), _found(spark, [f"{REAL} {t}" for t in W.TUNED])
    assert len(held) >= 0.7 * len(W.HELD) and len(tuned) >= 0.85 * len(W.TUNED)
    assert _found(spark, W.REPORTS) == {}


def test_every_kind(spark):
    texts = ["Rose by {{drug_name}} in all.", "Lorem ipsum dolor sit amet consectetur", "Your session has expired. Please log in again.", REAL]
    texts += [f"{REAL} Kept by team {k}. The page you requested could not be found." for k in range(4)]
    texts += [f"Charts of team {k} were kept well. Desk display will return shortly." for k in range(8)]
    kinds = _found(spark, texts)
    assert kinds[0] == "placeholder" and kinds[1] == "filler" and kinds[2] == "lone notice" and 3 not in kinds
    assert {kinds[k] for k in range(4, 8)} == {"repeated notice"}
    assert {kinds.get(k) for k in range(8, 16)} == {"repeated fragment"}


def test_title_on_the_same_matter_needs_repetition(spark):
    text = "The requested page could not be found."
    assert _found(spark, [text], title="Missing pages: what a requested page tells") == {}
    assert len(_found(spark, [text] * 3, title="Missing pages: what a requested page tells")) == 3


def test_wrapped_lines_and_signs(spark):
    assert set(_found(spark, [REAL + "\nThe page you are looking for\ndoes not exist.", "Please​ enable   JavaScript to view this page.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE."])) == {0, 1, 2}


def test_one_host_holds_most_rows(spark):
    texts = [REAL] * 300 + ["Access denied."] * 300
    df = spark.createDataFrame([(i, t, None, None, None if i % 2 else "big") for i, t in enumerate(texts)], SCHEMA).withColumn("kind", F.lit("clash"))
    assert {r["doc"] for r in residue.residue(df).collect()} == set(range(300, 600))


def test_nulls_and_nothing(spark):
    assert _found(spark, [None, "", "  \n", "page", "404"]) == {}
    assert residue.residue(spark.createDataFrame([], SCHEMA)).count() == 0
    assert _found(spark, ["x " * 100_000 + ". Access denied."], host=None) == {0: "lone notice"}
