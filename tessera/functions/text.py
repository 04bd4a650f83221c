"""Column expressions on texts and paths."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Lower-case letters with marks and their base letter, by decomposition."""
    a, b = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            base = unicodedata.normalize("NFD", c)
            if c.islower() and len(base) > 1 and base[0].isascii():
                a.append(c)
                b.append(base[0])
    return "".join(a), "".join(b)


FOLD_FROM, FOLD_TO = _folding()
TERM = r"[\p{L}\p{N}]+"

# Languages of file extensions, extensions that are indexed, extensions with symbols, names that are ignored.
LANGUAGES = {
    "cpp": "cpp", "hpp": "cpp", "h": "cpp", "cc": "cpp", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust",
    "java": "java", "cs": "c_sharp", "php": "php", "rb": "ruby", "md": "markdown", "json": "json", "txt": "text",
}
INDEXED = ["cpp", "hpp", "h", "md", "txt", "json", "py", "js", "ts", "go", "rs", "java", "cs", "php", "rb"]
WITH_SYMBOLS = ["py", "cpp", "hpp", "h", "cc", "go", "rs", "js", "ts", "java", "cs", "php", "rb"]
IGNORED = [
    ".git", ".svn", ".hg", "build", "dist", "node_modules", "*.o", "*.obj", "*.exe", "*.dll", "*.so", "*.dylib", ".DS_Store", "Thumbs.db", "config.json", "model.onnx", "vocab.txt",
]


def fold(c: Column) -> Column:
    """Lower case without diacritics; 'ß' stays."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), FOLD_FROM, FOLD_TO)


def terms(c: Column) -> Column:
    """Tokens of a text: runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(c), F.lit(f"({TERM})"), 1)


def fold_text(s: str) -> str:
    return "".join(c for c in s.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(FOLD_FROM, FOLD_TO))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension without the dot, '' if there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    e = extension(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(e == "", "unknown").otherwise(F.coalesce(F.try_element_at(known, e), e))


def is_indexed_type(path: Column) -> Column:
    return extension(path).isin(INDEXED)


def has_symbols(path: Column) -> Column:
    return extension(path).isin(WITH_SYMBOLS)


def glob_regex(glob: str) -> str:
    """'*' and '?' match any characters, '.' itself, '/' either slash; other characters keep their meaning in a regex."""
    table = {"*": ".*", "?": ".", ".": "\\.", "/": "[/\\\\]"}
    return "".join(table.get(c, c) for c in glob)


def parse_ignore_file(text: str) -> list[str]:
    return [x for x in (line.strip(" \t\r") for line in text.split("\n")) if x and not x.startswith("#")]


def ignored(path: Column, root: Column, globs: list[str]) -> Column:
    """Whether a component of ``path`` below ``root`` matches (a matching directory prunes what is in it)."""
    inner = F.split(F.substring(path, F.length(root) + 2, F.lit(1 << 30)), "/")
    if not globs:
        return F.lit(False)
    whole = "^(?:" + "|".join(glob_regex(g) for g in globs) + ")$"
    return F.exists(inner, lambda p: p.rlike(whole))


def uri(path: Column, scheme: str = "tessera://") -> Column:
    return F.concat(F.lit(scheme), path)


def path_of_uri(u: str, scheme: str = "tessera://") -> str:
    return u[len(scheme) :] if u.startswith(scheme) else u


def is_regex(glob: str) -> bool:
    try:
        re.compile(glob_regex(glob))
        return True
    except re.error:
        return False
