import pytest
from pyspark.sql import functions as F

from tessera.llm.canonical import canonical, canonicalise, look, lookalike_pairs

SAME = [
    ("ＡＢ１", "AB1"), ("ﬁle", "file"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("a b", "a b"), ("a‑b", "a-b"), ("a‐b", "a-b"), ("so­ft", "soft"),
    ("Тhe fаce", "The face"), ("ναlue", "value"), ("е́t", "ét"), ("a\r\nb", "a\nb"), ("e‍́", "é"),
]
OTHER = [("Der", "der"), ("fur", "für"), ("1496", "1896"), ("l", "1"), ("a b", "ab"), ("a b", "a\nb"), ("Вот", "Воt")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert look(a) == look(b) and canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_visible_difference(a, b):
    assert look(a) != look(b)


def test_forms():
    assert canonical("STRASSE") == canonical("straße") == "strasse" and canonical("") == ""
    assert look("привет мир") == "привет мир"  # words of another script stay
    assert canonical(canonical("Ｔｈе ﬀ")) == canonical("Ｔｈе ﬀ")


def test_pairs_against_brute_force(spark, data):
    t = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in t.collect() if r["text"] is not None]
    form = {i: look(x) for i, x in rows}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and form[a] == form[b]}
    assert {tuple(r) for r in lookalike_pairs(t).collect()} == want


def test_cases(spark):
    rows = [(1, "a b", "p"), (1, "a b", "p"), (2, "a b", "p"), (3, "a b", "p"), (4, None, "p"), (5, "", "p"), (6, "", "p"), (None, "a b", "p"), (7, "x" * 200_000 + " ", "p"), (8, "x" * 200_000 + " ", "p"), (9, "A b", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    assert {tuple(r) for r in lookalike_pairs(df).collect()} == {(1, 2), (2, 3), (7, 8)}
    assert lookalike_pairs(df.limit(0)).count() == 0
    c = canonicalise(df.withColumn("canonical", F.lit("old")), "text")
    assert c.count() == len(rows) and {r["canonical"] for r in c.filter("doc_id in (1, 2, 9)").collect()} == {"a b"} and c.filter("doc_id = 4").first()["canonical"] is None


def test_other_scripts_and_classes(spark):
    from tessera.llm.canonical import canonical, lookalike_groups

    assert canonical("pocт") == canonical("рост") != canonical("post") and canonical("ꓐꓰꓮ") == canonical("BEA") == canonical("ВЕА") == canonical("ᏼᎬᎪ".upper().replace("Ꮌ", "Ꭼ"))
    assert canonical("wаit") == "wait" and canonical("слово") == "слово" and canonical("λόγος") == "λόγοσ" and canonical("stopǃ") == "stop!"
    rows = [(1, "wait"), (2, "wаit"), (3, "wait"), (4, "other"), (5, "other"), (6, None), (7, ""), (2, "wаit"), (8, "Wait")]
    got = {tuple(r) for r in lookalike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
    assert lookalike_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
