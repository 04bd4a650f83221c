import sqlite3

import pytest

from tessera.operators.fulltext import QuerySyntaxError, build_postings, corpus_stats, parse_query, search_postings, search_texts

ROWS = ["a", "b", "c", "a b", "a c", "b c", "a b c", "x a b", "a x b", "Élan naïve snake_case_name Straße", "", "one two three four five six seven eight nine ten eleven twelve"]
CASES = {
    "a AND b NOT c": ["a b", "x a b", "a x b"],
    "a OR b NOT c": ["a", "b", "a b", "a c", "a b c", "x a b", "a x b"],
    "a NOT b c": ["a", "a b", "a c", "x a b", "a x b"],
    "a b OR c": ["c", "a b", "a c", "b c", "a b c", "x a b", "a x b"],
    "(a OR b) NOT c": ["a", "b", "a b", "x a b", "a x b"],
    '"a b"': ["a b", "a b c", "x a b"],
    "a + b": ["a b", "a b c", "x a b"],
    "NEAR(a b, 0)": ["a b", "a b c", "x a b"],
    "NEAR(a b, 1)": ["a b", "a b c", "x a b", "a x b"],
    "^a b": ["a b", "a b c", "a x b"],
    "- content : a": [],
    "case_name": [ROWS[9]],
    "elan": [ROWS[9]],
    "NEAR(one twelve)": [ROWS[11]],
    "NEAR(one twelve, 9)": [],
    "thre*": [ROWS[11]],
}
WRONG = ["what?", "a.b", "f()", "C++", "'a'", "", "  ", "a AND", "x-y", "std::x", "other : a", "NEAR(a, b)", "(a", "AND"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "extra") for k, t in enumerate(ROWS)], "id long, content string, rank string").cache()


@pytest.fixture(scope="module")
def lite():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(content)")
    c.executemany("insert into f(rowid, content) values (?, ?)", list(enumerate(ROWS)))
    return c


@pytest.mark.parametrize("query", CASES)
def test_matches_and_ranks(docs, lite, query):
    got = {r["id"]: r["rank"] for r in search_texts(docs, query).collect()}
    assert sorted(ROWS[i] for i in got) == sorted(CASES[query])
    want = dict(lite.execute("select rowid, rank from f where f match ?", (query,)).fetchall())
    assert set(want) == set(got)
    assert all(abs(want[i] - got[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("query", ["a b", "a OR c", '"a b" NOT c', "thre*", "NEAR(a b, 1)"])
def test_postings_give_the_same(docs, query):
    p, n = build_postings(docs)
    a = {r["id"]: round(r["rank"], 9) for r in search_texts(docs, query).collect()}
    assert a == {r["id"]: round(r["rank"], 9) for r in search_postings(p, corpus_stats(n), query).collect()}


@pytest.mark.parametrize("query", WRONG)
def test_syntax_errors_are_empty(docs, query):
    with pytest.raises(QuerySyntaxError):
        parse_query(query)
    assert search_texts(docs, query).count() == 0


def test_empty_table_and_nulls(spark):
    assert search_texts(spark.createDataFrame([], "id long, content string"), "a").count() == 0
    assert [r["id"] for r in search_texts(spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "id long, content string"), "a").collect()] == [2]
