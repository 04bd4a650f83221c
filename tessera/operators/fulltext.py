"""Full-text queries: the query language, matching and BM25 ranking.

A query is parsed on the driver into an expression over phrases; each distinct term becomes a slot, an array of the
positions at which it stands in a document. Slots come from a scan of the texts (one pass, no shuffle) or from a postings
index (only the lists of the query's terms are read); what follows is the same for both: Boolean operators, phrases, prefixes,
NEAR and first-token tests are expressions on the slots, and the ranking needs one row of corpus statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TERM, fold_text, terms
from tessera.schema import BM25_B, BM25_K1, IDF_FLOOR
from tessera.session import spread


class QuerySyntaxError(ValueError):
    pass


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False


@dataclass
class Near:
    phrases: list[Phrase]
    within: int = 10


@dataclass
class Op:
    kind: str  # and, or, not
    left: object
    right: object


@dataclass
class Nothing:
    """A subtree that a column filter excludes."""

    inner: object = None


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([()+*^:,{}-]))')
_TERMS = re.compile(r"[^\W_]+")


def tokenize(text: str) -> list[str]:
    return _TERMS.findall(fold_text(text))


@dataclass
class _Parser:
    """Recursive descent; tightest first: implicit AND, NOT, AND, OR."""

    toks: list = field(default_factory=list)
    at: int = 0

    def peek(self, k: int = 0):
        return self.toks[self.at + k] if self.at + k < len(self.toks) else ("end", "")

    def take(self, kind: str, value: str | None = None):
        t = self.peek()
        if t[0] != kind or (value is not None and t[1] != value):
            raise QuerySyntaxError(f"unexpected {t[1]!r}")
        self.at += 1
        return t[1]

    def is_op(self, name: str) -> bool:
        return self.peek() == ("word", name)

    def binary(self, names: list[str]):
        if not names:
            return self.implicit()
        out = self.binary(names[1:])
        while self.is_op(names[0]):
            self.at += 1
            out = Op(names[0].lower(), out, self.binary(names[1:]))
        return out

    def implicit(self):
        out = self.primary()
        while self.peek()[0] != "end" and self.peek() not in (("mark", ")"), ("mark", ",")) and not any(map(self.is_op, ("AND", "OR", "NOT"))):
            out = Op("and", out, self.primary())
        return out

    def primary(self):
        t = self.peek()
        if t == ("mark", "-") or (t[0] in ("word", "string") and self.peek(1) == ("mark", ":")) or t == ("mark", "{"):
            return self.columns()
        if t == ("mark", "("):
            self.at += 1
            e = self.binary(["OR", "AND", "NOT"])
            self.take("mark", ")")
            return e
        if t == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            return self.near()
        return self.phrase()

    def columns(self):
        negated = self.peek() == ("mark", "-")
        self.at += negated
        names = []
        if self.peek() == ("mark", "{"):
            self.at += 1
            while self.peek() != ("mark", "}"):
                names.append(self.name())
            self.at += 1
        else:
            names.append(self.name())
        self.take("mark", ":")
        if any(n.lower() != "content" for n in names):
            raise QuerySyntaxError("no such column")
        inner = self.primary()
        return Nothing(inner) if negated else inner

    def name(self) -> str:
        t = self.peek()
        if t[0] not in ("word", "string"):
            raise QuerySyntaxError("a column is expected")
        self.at += 1
        return t[1].strip('"')

    def near(self):
        self.at += 2
        phrases = []
        while self.peek() not in (("mark", ")"), ("mark", ",")):
            phrases.append(self.phrase())
        within = 10
        if self.peek() == ("mark", ","):
            self.at += 1
            n = self.take("word")
            if not n.isdigit():
                raise QuerySyntaxError("NEAR takes a number")
            within = int(n)
        self.take("mark", ")")
        if not phrases:
            raise QuerySyntaxError("NEAR is empty")
        return Near(phrases, within)

    def phrase(self) -> Phrase:
        first = self.peek() == ("mark", "^")
        self.at += first
        out = self.string()
        while self.peek() == ("mark", "+"):
            self.at += 1
            out += self.string()
        prefix = self.peek() == ("mark", "*")
        self.at += prefix
        return Phrase(out, prefix, first)

    def string(self) -> list[str]:
        t = self.peek()
        if t[0] == "string":
            self.at += 1
            return tokenize(t[1][1:-1].replace('""', '"'))
        if t[0] == "word" and t[1] not in ("AND", "OR", "NOT"):
            self.at += 1
            return tokenize(t[1])
        raise QuerySyntaxError(f"unexpected {t[1]!r}")


def parse_query(query: str):
    """The expression of a query; raises QuerySyntaxError."""
    toks, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QuerySyntaxError(f"at {query[at : at + 10]!r}")
        toks.append(("string", m.group(1)) if m.group(1) else ("word", m.group(2)) if m.group(2) else ("mark", m.group(3)))
        at = m.end()
    if not toks:
        raise QuerySyntaxError("the query is empty")
    p = _Parser(toks)
    e = p.binary(["OR", "AND", "NOT"])
    if p.peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {p.peek()[1]!r}")
    return e


def _phrases(e, out: list[Phrase]) -> list[Phrase]:
    if isinstance(e, Phrase):
        out.append(e)
    elif isinstance(e, Near):
        out.extend(e.phrases)
    elif isinstance(e, Op):
        _phrases(e.left, out)
        _phrases(e.right, out)
    return out


def slots_of(e) -> list[tuple[str, bool]]:
    """Distinct (term, is a prefix) of the expression."""
    seen = {}
    for p in _phrases(e, []):
        for k, t in enumerate(p.terms):
            seen[t, p.prefix and k == len(p.terms) - 1] = None
    return list(seen)


def _starts(p: Phrase, slot: dict) -> Column:
    """Positions at which the phrase begins."""
    keys = [(t, p.prefix and k == len(p.terms) - 1) for k, t in enumerate(p.terms)]
    if not keys:
        return F.array().cast("array<int>")
    rest = list(enumerate(keys))[1:]
    out = slot[keys[0]]
    if rest:
        def holds(x: Column) -> Column:
            ok = F.lit(True)
            for k, key in rest:
                ok = ok & F.array_contains(slot[key], x + k)
            return ok

        out = F.filter(out, holds)
    return F.filter(out, lambda x: x == 0) if p.first else out


def _near_starts(n: Near, slot: dict) -> list[Column]:
    """Positions of each phrase that belong to a clump: phrases whose last begins within ``within`` tokens after the first's end."""
    starts = [_starts(p, slot) for p in n.phrases]
    if len(starts) == 1:
        return starts
    sizes = [len(p.terms) for p in n.phrases]

    def clump(anchor: Column, size: int) -> Column:
        ok = F.lit(True)
        for s in starts:
            ok = ok & F.exists(s, lambda x: (x >= anchor) & (x <= anchor + size + n.within))
        return ok

    def reach(size: int):
        return lambda a: clump(a, size)

    def within(x: Column, size: int):
        return lambda y: (x >= y) & (x <= y + size + n.within)

    anchors = [F.filter(s, reach(z)) for s, z in zip(starts, sizes)]
    out = []
    for s in starts:
        def inside(x: Column) -> Column:
            ok = F.lit(False)
            for a, z in zip(anchors, sizes):
                ok = ok | F.exists(a, within(x, z))
            return ok

        out.append(F.filter(s, inside))
    return out


class Match:
    """Columns of an expression: whether a document matches; for each phrase its occurrences in the score and whether it is there.

    A phrase counts in the score only where the subtree that it belongs to matches: in ``a b OR c`` a row with a and c scores c
    alone, and what NOT excludes never scores."""

    def __init__(self, e, slot: dict[tuple[str, bool], Column]):
        self.phrases: list[tuple[Column, Column]] = []
        self.matches = self._of(e, slot)

    def _gate(self, first: int, ok: Column) -> None:
        for k in range(first, len(self.phrases)):
            n, there = self.phrases[k]
            self.phrases[k] = (F.when(ok, n).otherwise(0), there)

    def _of(self, e, slot) -> Column:
        first = len(self.phrases)
        if isinstance(e, Phrase):
            s = _starts(e, slot)
            self.phrases.append((F.size(s), F.size(s) > 0))
            return F.size(s) > 0
        if isinstance(e, Near):
            own = _near_starts(e, slot)
            ok = F.lit(True)
            for p, s in zip(e.phrases, own):
                self.phrases.append((F.size(s), F.size(_starts(p, slot)) > 0))
                ok = ok & (F.size(s) > 0)
            self._gate(first, ok)
            return ok
        if isinstance(e, Op):
            a = self._of(e.left, slot)
            middle = len(self.phrases)
            b = self._of(e.right, slot)
            if e.kind == "or":
                return a | b
            if e.kind == "and":
                self._gate(first, a & b)
                return a & b
            self._gate(first, a & ~b)
            self._gate(middle, F.lit(False))
            return a & ~b
        return F.lit(False)


def _ranked(docs: DataFrame, e, slot: dict, stats: DataFrame | None) -> DataFrame:
    """``docs`` has id, dl and the slots' columns; ``stats`` one row (n_docs, avgdl), computed from ``docs`` if None."""
    m = Match(e, slot)
    if not m.phrases:
        return docs.select("id", F.lit(0.0).alias("rank")).limit(0)
    f = docs.select("id", "dl", m.matches.alias("_m"), *[c[0].alias(f"_f{k}") for k, c in enumerate(m.phrases)], *[c[1].cast("int").alias(f"_h{k}") for k, c in enumerate(m.phrases)])
    n_rows = [F.sum(f"_h{k}").alias(f"_n{k}") for k in range(len(m.phrases))]
    if stats is None:
        s = f.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *n_rows)
    else:
        s = f.agg(*n_rows).crossJoin(F.broadcast(stats))  # one row each
    f = f.filter("_m").crossJoin(F.broadcast(s))  # one row
    score = F.lit(0.0)
    for k in range(len(m.phrases)):
        n, x = F.col(f"_n{k}"), F.col(f"_f{k}")
        idf = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        score = score + idf * x * (BM25_K1 + 1) / (x + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return f.select("id", (-score).alias("rank"))


def _positions(tokens: Column, term: str, prefix: bool) -> Column:
    hit = lambda x, i: F.when(x.startswith(term) if prefix else x == term, i)
    return F.filter(F.transform(tokens, hit), lambda i: i.isNotNull())


def search_texts(docs: DataFrame, query: str, id_col: str = "id", text: str = "content", once: bool = True) -> DataFrame:
    """(id, rank) of the rows that match, best (lowest) rank first when ordered by (rank, id). A query with a syntax error, or
    an empty one, matches nothing. NULL texts count as empty documents. Ids are expected once; with ``once`` off, repeated ids are
    reduced to one row after the texts have been read, so that only positions are moved, not texts."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text"))
    try:
        e = parse_query(query)
    except QuerySyntaxError:
        return base.select("id", F.lit(0.0).alias("rank")).limit(0)
    want = slots_of(e)
    # a generator keeps the tokens from being computed again for each use
    t = spread(base).select("id", F.explode(F.array(F.coalesce(terms(F.col("_text")), F.array().cast("array<string>")))).alias("_t"))
    cols = []
    for k, (term, prefix) in enumerate(want):
        cols.append(_positions(F.col("_t"), term, prefix).alias(f"_s{k}"))
    d = t.select("id", F.size("_t").alias("dl"), F.explode(F.array(F.struct(F.lit(0).alias("_"), *cols))).alias("_p")).select("id", "dl", "_p.*")
    d = d if once else d.dropDuplicates(["id"])
    return _ranked(d, e, {key: F.col(f"_s{k}") for k, key in enumerate(want)}, None)


def build_postings(docs: DataFrame, id_col: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (term, id, dl, positions) and (id, dl). Written sorted by term, a query reads few row groups. An id that is
    delivered twice with one text counts once; texts are not moved, only their terms and positions."""
    t = spread(docs.select(id_col, text)).select(F.col(id_col).alias("id"), F.explode(F.array(F.coalesce(terms(F.col(text)), F.array().cast("array<string>")))).alias("t"))
    p = t.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term")).groupBy("term", "id").agg(F.max("dl").alias("dl"), F.array_sort(F.collect_set("pos")).alias("positions"))
    return p.select("term", "id", "dl", "positions"), t.select("id", F.size("t").alias("dl")).groupBy("id").agg(F.max("dl").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def search_postings(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """``search_texts`` over a postings index: reads the lists of the query's terms only."""
    try:
        e = parse_query(query)
    except QuerySyntaxError:
        return postings.select("id", F.lit(0.0).alias("rank")).limit(0)
    want = slots_of(e)
    if not want:
        return postings.select("id", F.lit(0.0).alias("rank")).limit(0)
    test = lambda term, prefix: F.col("term").startswith(term) if prefix else F.col("term") == term
    any_of = F.lit(False)
    for key in want:
        any_of = any_of | test(*key)
    cols = [F.array_sort(F.flatten(F.collect_list(F.when(test(*key), F.col("positions"))))).alias(f"_s{k}") for k, key in enumerate(want)]
    d = postings.filter(any_of).groupBy("id").agg(F.first("dl").alias("dl"), *cols)
    return _ranked(d, e, {key: F.col(f"_s{k}") for k, key in enumerate(want)}, stats)


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy("rank", "id").limit(k)


__all__ = ["TERM", "Match", "QuerySyntaxError", "build_postings", "corpus_stats", "parse_query", "search_postings", "search_texts", "slots_of", "top"]
