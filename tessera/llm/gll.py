"""A generalised LL recogniser with a graph-structured stack, over texts whose brackets are reduced first.

A grammar is written as text: ``Name = alternative | alternative ;`` with literals in quotes, other names, token classes
in capitals, groups ``( )``, ``? * +``, and ``paren(X)``, ``brack(X)``, ``brace(X)`` for a bracket pair whose content is X. An
alternative that begins with ``@name`` belongs to that dialect only. All dialects are recognised in the same run: every
descriptor carries the set of dialects it is valid in, as bits, and a text is accepted in the union over its derivations.

Tokens are single characters. Innermost brackets are recognised first and replaced by one character that stands for
the set of contents that the group can be, so that equal groups and equal statements are recognised once however often
they occur; results are kept with the text they were looked up in, including the lookahead.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|(paren|brack|brace)\(\s*(\w+)\s*\)|(@\w+)|(\w+)|([=|;()?*+]))")
_OPEN = {"paren": "(", "brack": "[", "brace": "{"}
OPT, STAR = 1, 2
_GROUP = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_LAST = "\0"
#: Entries of the caches for short and for long texts, and their most characters; a full cache is emptied. Short texts come again
#: and again and are not lost when long ones, of which most come once, have filled theirs; longer ones are not kept.
CACHE, SHORT = 200_000, 80
CACHE_LONG, KEPT = 20_000, 600
#: Different kinds of bracket groups that are remembered from text to text.
MOST_KINDS = 50_000


class Grammar:
    """Compiled grammar. ``literals`` gives the character of each literal; ``classes`` that of each token class."""

    def __init__(self, text: str, dialects: list[str], start: str, classes: dict[str, str], kept: tuple[str, ...] = ()):
        self.dialects = {d: 1 << k for k, d in enumerate(dialects)}
        self.all = (1 << len(dialects)) - 1
        self.classes = classes
        self.literals: dict[str, str] = {}
        self._rules: dict[str, list] = {}
        self._parse(text)
        self._compile()
        self.start = self.ids[start]
        self.kept = {self.ids[k] for k in kept}
        self._sig: dict[str, str] = {}
        self._sig_long: dict[str, str] = {}
        self._of: dict[tuple, str] = {}
        self.group: dict[str, tuple[str, dict[int, int]]] = {}
        self._memo: dict = {}
        self._lens: dict = {}

    # --- text to rules ---

    def _parse(self, text: str) -> None:
        toks, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"grammar at {text[at : at + 40]!r}")
            toks.append(m)
            at = m.end()
        self._i, self._toks, self._fresh = 0, toks, 0
        while self._i < len(toks):
            name = toks[self._i].group(5)
            self._i += 2
            self._rules.setdefault(name, []).extend(self._alternatives())
            self._i += 1

    def _alternatives(self) -> list:
        out = [self._sequence()]
        while self._i < len(self._toks) and self._toks[self._i].group(6) == "|":
            self._i += 1
            out.append(self._sequence())
        return out

    def _sequence(self) -> tuple[int, list]:
        mask, seq = self.all, []
        while self._i < len(self._toks):
            m = self._toks[self._i]
            if m.group(4):
                mask = self.dialects[m.group(4)[1:]]
                self._i += 1
                continue
            if m.group(6) in ("|", ";", ")"):
                break
            self._i += 1
            if m.group(6) == "(":
                inner = self._alternatives()
                self._i += 1
                self._fresh += 1
                sym = ("n", f"_{self._fresh}")
                self._rules[sym[1]] = inner
            elif m.group(1):
                sym = ("t", self._literal(m.group(1).replace("\\'", "'")))
            elif m.group(2):
                sym = ("g", (_OPEN[m.group(2)], m.group(3)))
            elif m.group(5) in self.classes:
                sym = ("t", self.classes[m.group(5)])
            else:
                sym = ("n", m.group(5))
            mark = self._toks[self._i].group(6) if self._i < len(self._toks) else None
            if mark in ("?", "*", "+"):
                self._i += 1
                if sym[0] != "n":
                    self._fresh += 1
                    self._rules[f"_{self._fresh}"] = [(self.all, [sym])]
                    sym = ("n", f"_{self._fresh}")
                if mark == "+":
                    seq.append(sym)
                seq.append(("?" if mark == "?" else "*", sym[1]))
            else:
                seq.append(sym)
        return mask, seq

    def _literal(self, s: str) -> str:
        if s not in self.literals:
            self.literals[s] = s if len(s) == 1 and not s.isalnum() else chr(0xE000 + len(self.literals))
        return self.literals[s]

    # --- rules to slots ---

    def _compile(self) -> None:
        self.ids = {n: k for k, n in enumerate(self._rules)}
        self.names = list(self._rules)
        self.kind: list = []  # of a slot: 't', 'g', 'n', '?', '*' or '' at the end of an alternative
        self.arg: list = []
        self.alts: list[list[tuple[int, int]]] = []
        contents: dict[str, set[str]] = {"(": set(), "[": set(), "{": set()}
        for n in self.names:
            own = []
            for mask, seq in self._rules[n]:
                own.append((len(self.kind), mask))
                for k, a in seq:
                    if k in "n?*" and a not in self.ids:
                        raise ValueError(f"undefined {a}")
                    if k == "g":
                        contents[a[0]].add(a[1])
                        a = (a[0], self.ids[a[1]])
                    self.kind.append(k)
                    self.arg.append(self.ids[a] if k in "n?*" else a)
                self.kind.append("")
                self.arg.append(self.ids[n])
            self.alts.append(own)
        self.contents = {b: sorted(self.ids[x] for x in v) for b, v in contents.items()}
        first: list[set] = [set() for _ in self.names]
        null = [False] * len(self.names)
        changed = True
        while changed:
            changed = False
            for k, alts in enumerate(self.alts):
                for slot, _ in alts:
                    f, empty = set(), True
                    while self.kind[slot]:
                        kind, a = self.kind[slot], self.arg[slot]
                        f |= {a} if kind == "t" else {a[0]} if kind == "g" else first[a]
                        if kind in "tg" or kind == "n" and not null[a]:
                            empty = False
                            break
                        slot += 1
                    if not f <= first[k] or empty and not null[k]:
                        first[k] |= f
                        null[k] |= empty
                        changed = True
        self.first, self.null = first, null
        # what an alternative can begin with; None if it can be empty
        self.alt_first: list[list[set | None]] = []
        for alts in self.alts:
            own = []
            for slot, _ in alts:
                f: set | None = set()
                while f is not None:
                    kind, a = self.kind[slot], self.arg[slot]
                    if not kind:
                        f = None
                        break
                    f |= {a} if kind == "t" else {a[0]} if kind == "g" else first[a]
                    if kind in "tg" or kind == "n" and not null[a]:
                        break
                    slot += 1
                own.append(f)
            self.alt_first.append(own)
        self._picked: dict = {}

    # --- recognition ---

    def _run(self, goals: list[int], s: str, at: int) -> tuple[list[dict[int, int]], int]:
        """For each goal the ends of its derivations from ``at`` with their dialects; and how far the text was read.
        ``s`` ends in a character that no terminal matches."""
        kind, arg, first, null, group, kept, picked = self.kind, self.arg, self.first, self.null, self.group, self.kept, self._picked
        wide = len(kind)
        nodes: dict = {}
        todo: list = []
        far = at

        def node(n: int, i: int, c: str):
            v = nodes[n, i] = ({}, {}, {}, len(nodes))  # ends, returns, descriptors seen, number
            some = picked.get((n, c))
            if some is None:
                some = picked[n, c] = [(slot, mask) for (slot, mask), f in zip(self.alts[n], self.alt_first[n]) if f is None or c in f]
            for slot, mask in some:
                todo.append((slot, v, i, mask))
            return v

        c = s[at]
        g = group.get(c)
        roots = [node(n, at, g[0] if g else c) for n in goals]
        while todo:
            slot, top, i, mask = todo.pop()
            k = slot + i * wide
            old = top[2].get(k, 0)
            mask &= ~old
            if not mask:
                continue
            top[2][k] = old | mask
            while True:
                what = kind[slot]
                if what == "":
                    ends = top[0]
                    was = ends.get(i, 0)
                    new = mask & ~was
                    if new:
                        ends[i] = was | new
                        for r, (rn, rm) in top[1].items():
                            if rm & new:
                                todo.append((r[0], rn, i, rm & new))
                    break
                if i >= far:
                    far = i + 1
                c = s[i]
                if what == "t":
                    if c != arg[slot]:
                        break
                    slot += 1
                    i += 1
                    continue
                g = group.get(c)
                if what == "g":
                    if g is None or g[0] != arg[slot][0]:
                        break
                    mask &= g[1].get(arg[slot][1], 0)
                    if not mask:
                        break
                    slot += 1
                    i += 1
                    continue
                n = arg[slot]
                if g is not None:
                    c = g[0]
                if c not in first[n]:
                    if what != "n" or null[n]:
                        slot += 1
                        continue
                    break
                to = slot if what == "*" else slot + 1
                if what != "n" or null[n]:
                    todo.append((slot + 1, top, i, mask))
                v = nodes.get((n, i))
                if v is None:
                    if n in kept:
                        ends, read = self._known(n, s, i)
                        if read > far:
                            far = read
                        for e, m in ends:
                            if m & mask:
                                todo.append((to, top, e, m & mask))
                        break
                    v = node(n, i, c)
                r = (to, top[3])
                was = v[1].get(r)
                v[1][r] = (top, mask | was[1] if was else mask)
                for e, m in v[0].items():
                    if m & mask:
                        todo.append((to, top, e, m & mask))
                break
        return [r[0] for r in roots], far

    def _known(self, n: int, s: str, i: int) -> tuple[list[tuple[int, int]], int]:
        """Ends of ``n`` at ``i``, from the cache of texts read before or by a run of its own."""
        lens = self._lens.get((n, s[i : i + 2]))
        if lens:
            for size in lens:
                hit = self._memo.get((n, s[i : i + size]))
                if hit is not None:
                    return [(i + e, m) for e, m in hit], i + size
        kept, self.kept = self.kept, self.kept - {n}
        (ends,), far = self._run([n], s, i)
        self.kept = kept
        size = far - i
        if size > KEPT:
            return list(ends.items()), far
        if len(self._memo) >= CACHE:
            self._memo.clear()
            self._lens.clear()
        self._memo[n, s[i:far]] = [(e - i, m) for e, m in ends.items()]
        lens = self._lens.setdefault((n, s[i : i + 2]), [])
        if size not in lens:
            lens.append(size)
        return list(ends.items()), far

    def renew(self) -> None:
        """Forget what bracket groups stand for when there are many of them. Between texts only: a reduced text holds their characters."""
        if len(self._of) > MOST_KINDS:
            for cache in (self._sig, self._sig_long, self._of, self.group, self._memo, self._lens, self._picked):
                cache.clear()

    def _reduced(self, m: re.Match) -> str:
        whole = m.group()
        cache, most = (self._sig, CACHE) if len(whole) <= SHORT else (self._sig_long, CACHE_LONG)
        c = cache.get(whole)
        if c is None:
            b, body = whole[0], whole[1:-1] + _LAST
            goals = self.contents[b]
            ends = self._run(goals, body, 0)[0] if goals else []
            sig = tuple(e.get(len(body) - 1, 0) for e in ends)
            c = self._of.get((b, sig))
            if c is None:
                c = self._of[b, sig] = chr(0xF0000 + len(self._of))
                self.group[c] = (b, dict(zip(goals, sig)))
            if len(whole) <= KEPT:
                if len(cache) >= most:
                    cache.clear()
                cache[whole] = c
        return c

    def reduce(self, s: str, clean=None) -> str:
        """``s`` with all balanced brackets replaced; ``clean`` is applied to the inside of a group first."""
        if clean:
            sub = lambda m: self._reduced(_Match(m.group()[0] + clean(m.group()[1:-1]) + m.group()[-1]))
        else:
            sub = self._reduced
        n = 1
        while n:
            s, n = _GROUP.subn(sub, s)
        return s

    def accepts(self, s: str) -> int:
        """The dialects, as bits, that the reduced token text is a sentence of."""
        if any(c in s for c in "()[]{}"):
            return 0
        return self._run([self.start], s + _LAST, 0)[0][0].get(len(s), 0)


class _Match:
    def __init__(self, s: str):
        self._s = s

    def group(self) -> str:
        return self._s
