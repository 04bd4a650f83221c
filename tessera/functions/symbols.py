"""Symbols and calls of source texts.

Python is parsed by its own parser, with an indentation scanner for texts that it rejects. Other languages are scanned with
strings and comments blanked out: a declaration's head is found by a pattern of the language, its body by matching braces.
"""

from __future__ import annotations

import ast
import re
import warnings
from typing import NamedTuple


class Symbol(NamedTuple):
    content: str
    start_line: int
    end_line: int
    symbol_name: str
    symbol_type: str


_NOISE = {
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "ruby": re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S),
    "php": re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S),
}
_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|partial|synchronized|native|default|readonly|unsafe|extern|inline|constexpr|export)\s+)*"
_TYPE = r"(?:[\w:.<>,\[\]?&* ]+?[\s&*>\]])"
# (kind, head); a head ends before the body's opening brace
_HEADS = {
    "cpp": [("class", rf"\bclass\s+{_N}[^;{{}}()]*"), ("function", rf"(?:^|(?<=[;}}{{:\n]))[ \t]*{_MODS}(?!return\b|else\b|new\b){_TYPE}{_N}\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{}}]*)?")],
    "go": [("class", rf"\btype\s+{_N}\s+(?:struct|interface)\s*"), ("class", rf"\btype\s+{_N}\s+[\w.*\[\]]+(?=\n)"), ("function", rf"\bfunc\s+(?:\([^)]*\)\s*)?{_N}\s*\([^{{}}]*?\)[^{{}}\n]*")],
    "rust": [("class", rf"\bstruct\s+{_N}[^;{{}}]*"), ("function", rf"\benum\s+{_N}[^;{{}}]*"), ("function", rf"\bfn\s+{_N}[^;{{}}]*"), ("function", r"\b(?P<name>)impl\b[^;{}]*")],
    "javascript": [("class", rf"\bclass\s+{_N}[^{{}}()]*"), ("function", rf"\b(?:async\s+)?function\s*\*?\s*{_N}\s*\([^{{}}]*?\)[^{{}};=]*"), ("function", rf"(?:^|(?<=[;}}{{\n]))[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*{_N}\s*(?:<[^>{{}}]*>)?\([^;{{}}]*?\)\s*(?::[^;{{}}=]+)?")],
    "java": [("class", rf"\bclass\s+{_N}[^;{{}}()]*"), ("function", rf"(?:^|(?<=[;}}{{\n]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>]+>\s*)?(?!return\b|else\b|new\b|throw\b){_TYPE}{_N}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?")],
    "php": [("class", rf"\bclass\s+{_N}[^;{{}}()]*"), ("function", rf"\bfunction\s+&?{_N}\s*\([^;{{}}]*\)[^;{{}}]*")],
}
_HEADS["typescript"], _HEADS["c_sharp"] = _HEADS["javascript"], _HEADS["java"]
_COMPILED = {k: [(kind, re.compile(h, re.M)) for kind, h in v] for k, v in _HEADS.items()}
_KEYWORDS = frozenset(
    "if else for while switch catch return sizeof new delete throw function func fn def class struct enum match loop in and or not elif with except lambda await yield typeof instanceof foreach using lock fixed do try finally unless until case when super this self defer go select range print assert del raise import from as is import_once require include echo isset array list unset".split()
)
_CALL = re.compile(r"(?<![\w$.>:])([A-Za-z_$][\w$]*)\s*\(")
_CALL_DEF = re.compile(r"(?:\b(?:def|function|func|fn|class|new|struct|enum|interface|void|int|auto|bool|string|double|float|char|long)\s*\*?\s*&?)$")
LANGUAGES = ["python", *_HEADS, "ruby"]


def blanked(text: str, language: str) -> str:
    """The text with strings and comments replaced by spaces; line ends stay."""
    rx = _NOISE.get(language if language in _NOISE else "c")
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _body_end(s: str, at: int) -> int | None:
    """The end of the braces that begin at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(s, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return None


def _lines(text: str, a: int, b: int) -> tuple[int, int]:
    first = text.count("\n", 0, a) + 1
    return first, first + text.count("\n", a, b)


def _python(text: str) -> list[Symbol]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(text)
    lines = text.split("\n")
    out = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            part = lines[n.lineno - 1 : n.end_lineno]
            part[0] = part[0][n.col_offset :]
            out.append((n.lineno, n.col_offset, Symbol("\n".join(part), n.lineno, n.end_lineno, n.name, "class" if isinstance(n, ast.ClassDef) else "function")))
    return [s for *_, s in sorted(out, key=lambda x: x[:2])]


def _indented(text: str) -> list[Symbol]:
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line)
        if m:
            depth, end = len(m.group(1).expandtabs()), k
            for j in range(k + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= depth:
                        break
                    end = j
            out.append(Symbol("\n".join([line[len(m.group(1)) :], *lines[k + 1 : end + 1]]), k + 1, end + 1, m.group(3), "class" if m.group(2) == "class" else "function"))
    return out


def _ruby(text: str) -> list[Symbol]:
    lines, out = blanked(text, "ruby").split("\n"), []
    real = text.split("\n")
    for k, line in enumerate(lines):
        m = re.match(r"([ \t]*)(def|class)\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", line)
        if m:
            end = next((j for j in range(k + 1, len(lines)) if re.match(re.escape(m.group(1)) + r"end\b", lines[j])), None)
            if end is not None:
                out.append(Symbol("\n".join([real[k][len(m.group(1)) :], *real[k + 1 : end + 1]]), k + 1, end + 1, m.group(3), "class" if m.group(2) == "class" else "function"))
    return out


def extract_symbols(text: str | None, language: str | None) -> list[Symbol]:
    """Classes and functions in order of their place, nested ones after the one they are in; lines from 1. An unknown language, NULL
    or an empty text gives none."""
    if not text or language is None:
        return []
    if language == "python":
        return _python(text)
    if language == "ruby":
        return _ruby(text)
    if language not in _COMPILED:
        return []
    s = blanked(text, language)
    found: dict[int, tuple[int, str, str]] = {}
    for kind, rx in _COMPILED[language]:
        for m in rx.finditer(s):
            name = m.group("name")
            if name in _KEYWORDS:
                continue
            a = m.start() + len(m.group()) - len(m.group().lstrip())
            at = m.end() + len(s[m.end() :]) - len(s[m.end() :].lstrip()) if m.end() < len(s) else m.end()
            if at < len(s) and s[at] == "{":
                end = _body_end(s, at)
            elif kind == "class" and language in ("go", "rust"):
                end = s.find("\n", m.end()) if language == "go" else s.find(";", m.start()) + 1
                end = len(s) if end <= 0 else end
            else:
                continue
            if end is not None and a not in found:
                found[a] = (end, name, kind)
    out = []
    for a, (b, name, kind) in sorted(found.items()):
        first, last = _lines(text, a, b)
        out.append(Symbol(text[a:b], first, last, name, kind))
    return out


def extract_calls(text: str | None, language: str | None) -> list[tuple[int, str]]:
    """(offset, name) of calls of bare identifiers, repeated ones kept; calls of members, and definitions, are none."""
    if not text or language is None or language not in LANGUAGES:
        return []
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
            starts = [0]
            for line in text.split("\n"):
                starts.append(starts[-1] + len(line) + 1)
            return sorted((starts[n.lineno - 1] + n.col_offset, n.func.id) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    s = blanked(text, "ruby" if language == "python" else language)
    heads = {m.start("name") for kind, rx in _COMPILED.get(language, []) for m in rx.finditer(s) if m.group("name") not in _KEYWORDS and kind == "function" and re.match(r"\s*\{", s[m.end() : m.end() + 200])}
    return [(m.start(1), m.group(1)) for m in _CALL.finditer(s) if m.group(1) not in _KEYWORDS and m.start(1) not in heads and not _CALL_DEF.search(s[max(0, m.start(1) - 24) : m.start(1)])]
