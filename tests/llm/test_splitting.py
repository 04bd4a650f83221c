import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.splitting import pieces_of_all, split_oversized, split_text


def size(s):
    return len(s.encode("utf-8", "surrogatepass"))


@settings(max_examples=400, deadline=None)
@given(st.text("ab .\n\r é中\t#", max_size=400), st.integers(8, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    back = ""
    for k, (p, at, over) in enumerate(pieces):
        assert size(p) <= limit and text[at : at + len(p)] == p
        back += p.encode()[over:].decode() if k else p
        if k:
            assert over <= overlap and (over > overlap - 4 or over >= size(pieces[k - 1][0]) - 3)
    assert back == text


def test_natural_boundaries():
    text = "\n\n".join("Sentence number one. Sentence number two." for _ in range(20))
    p = split_text(text, 200, 20)
    assert all(x[0].endswith("\n\n") for x in p[:-1])
    lines = "\n".join("word " * 5 for _ in range(30))
    assert all(x[0].endswith("\n") for x in split_text(lines, 100, 10)[:-1])
    assert all(x[0].endswith(" ") for x in split_text("word " * 100, 60, 10)[:-1])
    assert [len(x[0]) for x in split_text("x" * 100, 40, 0)] == [40, 40, 20]


def test_refuses():
    for bad in ((4, 0), (100, 51), (100, -1)):
        with pytest.raises(ValueError):
            split_text("x", *bad)


def test_table(spark):
    long = "\n".join(f"line {k}" for k in range(2000))
    rows = [(1, long, 5, "x"), (1, long, 5, "x"), (2, "short\n", 3, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (None, long, 1, "x"), (5, "é" * 3000, None, "x"), (6, "y" * 4000, 1, "x")]
    df = spark.createDataFrame(rows, "id long, content string, start_line int, piece_no string")
    got = split_oversized(df).collect()
    assert {r["id"] for r in got} == {1, 5}
    one = sorted((r for r in got if r["id"] == 1), key=lambda r: r["piece_no"])
    assert one[0]["n_pieces"] == len(one) and one[0]["start_line"] == 5 and one[-1]["end_line"] == 5 + 1999
    for r in one:
        first = r["content"].split("\n")[0]
        assert r["n_bytes"] <= 4000
        if first.startswith("line ") and r["piece_no"] == 0:
            assert r["start_line"] == 5 + int(first[5:])
        last = r["content"].rstrip("\n").split("\n")[-1]
        assert r["end_line"] == 5 + int(last[5:])
    assert split_oversized(df.limit(0)).count() == 0
    everything = {(r["id"], r["piece_no"]): (r["start_line"], r["end_line"]) for r in pieces_of_all(df).collect()}
    assert everything[2, 0] == (3, 3) and everything[4, 0] == (1, 1) and everything[6, 0] == (1, 1)


def test_audit(spark):
    from tessera.llm.splitting import audited

    rows = [(1, "a line\n" * 2000, 5), (2, "é" * 5000, None), (3, "short", 1), (4, None, 1), (5, "x y\r\n" * 1500, 7), (5, "x y\r\n" * 1500, 7)]
    got = {tuple(r) for r in audited(spark.createDataFrame(rows, "id long, content string, start_line int")).collect()}
    assert got == {(k, True, True, True) for k in (1, 2, 5)}
