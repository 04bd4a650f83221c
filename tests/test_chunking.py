import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking as K


def plain(text, size, overlap):
    """The rules in plain Python."""
    def cut(t, seps):
        if len(t) <= size or not seps:
            return [t]
        return [y for x in re.findall(rf"(?s).*?{seps[0]}|.+", t) for y in cut(x, seps[1:])]

    out, buf, a, b, ln = [], "", 1, 1, 1
    for p in cut(text, ["\n\n", "\n", " "]) if text else []:
        end = ln + p.count("\n")
        if buf and len(buf) + len(p) > size:
            out.append((buf, a, b))
            tail = buf[-overlap:] if overlap else ""
            a = max(1, b - tail.count("\n"))
            buf = tail + p
            b = a + buf.count("\n")
        else:
            a = ln if not buf else a
            buf += p
            b = end
        ln = end
    return out + ([(buf, a, b)] if buf else [])


def test_documents_against_plain_python(spark, data):
    t = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for size, overlap in ((4000, 600), (200, 30), (50, 0)):
        got = {}
        for r in K.chunk_table(t, "doc_id", "text", size, overlap).orderBy("ordinal").collect():
            got.setdefault(r["id"], []).append((r["content"], r["start_line"], r["end_line"]))
        for r in t.collect():
            assert got.get(r["doc_id"], []) == plain(r["text"] or "", size, overlap)


@pytest.mark.parametrize("text,size,share", [("one.\n\ntwo two.\n\nthree three", 15, 0.0), ("words " * 20, 20, 0.25), ("short\nthe second line is longer", 10, 0.0), ("", 10, 0.0), ("a\n\n\nb", 2, 0.0), ("x" * 50, 10, 0.0), ("a\r\nb\r\nc", 4, 0.0), ("é è à ü ö", 4, 0.25), (None, 5, 0.0)])
def test_cases(spark, text, size, share):
    overlap = K.overlap_size(size, share)
    r = spark.createDataFrame([(text,)], "t string").select(K.recursive_chunks(F.col("t"), size, overlap).alias("c")).first()["c"]
    assert [tuple(x) for x in r] == plain(text or "", size, overlap)
    for a, b in zip(r, r[1:]):
        assert b["content"].startswith(a["content"][-overlap:] if overlap else "")


def test_overlap_is_cut_in_single_precision():
    assert K.overlap_size(4000, 0.15) == 600 and K.overlap_size(20, 0.25) == 5


def test_line_chunks(spark):
    rows = [(0, ""), (1, "a"), (2, "a\nb\n"), (3, "\n".join(map(str, range(11)))), (4, None)]
    got = {r["id"]: [tuple(x) for x in r["c"]] for r in spark.createDataFrame(rows, "id int, t string").select("id", K.line_chunks(F.col("t"), 5, 2).alias("c")).collect()}
    assert got[0] == got[4] == [] and got[1] == [("a\n", 1, 1)] and got[2] == [("a\nb\n", 1, 2)]
    assert [x[1:] for x in got[3]] == [(1, 5), (4, 8), (7, 11)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=120), st.lists(st.integers(0, 120), max_size=10), st.integers(5, 30))
def test_breakpoints_cover_the_text(text, bps, size):
    parts = K.cut_at(text, bps, size, size // 4)
    assert all(len(p) <= size for p in parts)
    at = 0
    for p in parts:
        k = text.find(p, max(0, at - size // 4))
        assert k >= 0
        at = k + len(p)
    assert at == len(text) or not text


def test_breakpoints_refuse_large_overlaps():
    with pytest.raises(ValueError):
        K.cut_at("abc", [], 10, 5)
