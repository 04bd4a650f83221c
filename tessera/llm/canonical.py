"""Texts that look the same in one form (problem 10).

The form is compatibility normalisation (composed), full case folding, mapped white space and hyphens, look-alike
letters of other scripts mapped to Latin, and default-ignorable characters removed. Look-alikes are mapped word by
word, and only where the word holds a Latin letter or nothing but look-alikes, so that Russian or Greek words stay; a word with letters
that only the other script has takes its Latin look-alikes into that script.

Plain ASCII needs none of it but case folding and is treated inside the JVM; other texts go to Python in Arrow batches,
each distinct value of a batch once.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, spread

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "ӏ": "l", "ԁ": "d", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X",
    "У": "Y", "Ү": "Y", "Ԍ": "G", "Ӏ": "I",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin beyond the basic block
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ǃ": "!",
    # Cyrillic of small capital look
    "ԍ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Hyphens of the same look as the hyphen-minus.
HYPHENS = "‐‑˗⁃﹣－"

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SPACE = regex.compile(r"[\p{Zs}\t]")
_LINE = regex.compile("\r\n|[\r\x0b\x0c\x85  ]")
_WORD = regex.compile(r"[\p{L}\p{M}]+|ǃ")
_OTHER = regex.compile(r"[^\x00-\x7f]")
_TO_LATIN = str.maketrans(LOOKALIKES)
_TO_HYPHEN = str.maketrans(dict.fromkeys(HYPHENS, "-"))
_ALIKE = frozenset(LOOKALIKES)
_HYPHEN = frozenset(HYPHENS)
#: Latin letters and their look-alikes of one script, the first of several.
_FROM_LATIN = {s: {v: k for k, v in reversed(LOOKALIKES.items()) if unicodedata.name(k).startswith(s)} for s in ("CYRILLIC", "GREEK", "ARMENIAN")}
ASCII = r"^[\x00-\x7F]*$"


def _word(m) -> str:
    w = m.group()
    if w.isascii():
        return w
    base = [c for c in w if not unicodedata.combining(c)]
    own = {unicodedata.name(c, "").split(" ")[0] for c in base if not c.isascii() and c not in _ALIKE}
    latin = {c for c in base if c.isascii()}
    if len(own) == 1 and (script := own.pop()) in _FROM_LATIN and latin and latin <= _FROM_LATIN[script].keys():
        return w.translate(str.maketrans(_FROM_LATIN[script]))
    if any("LATIN" in unicodedata.name(c, "") for c in base) or all(c in _ALIKE for c in base):
        return w.translate(_TO_LATIN)
    return w


def look(text: str) -> str:
    """The form with case kept: equal for texts that look the same."""
    t = _LINE.sub("\n", text)
    if not t.isascii():
        t = _IGNORABLE.sub("", unicodedata.normalize("NFKD", t))
        t = _WORD.sub(_word, t)
        t = unicodedata.normalize("NFKC", t.translate(_TO_HYPHEN) if not _HYPHEN.isdisjoint(t) else t)
    return _SPACE.sub(" ", t)


def canonical(text: str) -> str:
    """The form for comparisons: ``look`` with full case folding."""
    return folded(look(text))


def folded(looks: str) -> str:
    t = looks.casefold()
    return t if t.isascii() else _IGNORABLE.sub("", unicodedata.normalize("NFKC", t))


def _each(s: pd.Series, f) -> pd.Series:
    done = {v: f(v) for v in s.dropna().unique()}
    return s.map(done).astype(object).where(s.notna(), None)


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return _each(s, canonical)


def _native(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n|[\r\x0b\x0c]", "\n"), "\t", " ")


def canonical_text(c: Column) -> Column:
    """Column of the comparison form. NULL stays NULL, '' stays ''."""
    plain = c.rlike(ASCII)
    return F.when(plain, F.lower(_native(c))).otherwise(_canonical_udf(F.when(~plain, c)))


@F.pandas_udf(T.StructType([T.StructField("form", T.BinaryType()), T.StructField("look", T.BinaryType())]))
def _keys_udf(s: pd.Series) -> pd.DataFrame:
    md5 = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()

    def keys(t: str) -> tuple[bytes, bytes]:
        x = look(t)
        return md5(folded(x)), md5(x)

    done = {v: keys(v) for v in s.dropna().unique()}
    none = (None, None)
    return pd.DataFrame([done.get(v, none) for v in s], columns=["form", "look"])


def canonicalise(df: DataFrame, text: str, into: str = "canonical") -> DataFrame:
    """``df`` with the comparison form of column ``text``; rows and other columns stay.

    An input column named like ``into`` is replaced. NULL gives NULL, an empty table an empty table."""
    return spread(df).withColumn(into, canonical_text(F.col(text)))


def lookalike_classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row a document: (doc_id, text_key, form_key, look_key), keys being 128-bit digests of the text, its
    comparison form and its form with case. NULL texts have no row; repeated rows count once."""
    c = F.col("_t")
    md5 = lambda x: F.unhex(F.md5(x.cast("binary")))
    d = spread(df.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), "doc_id")
    plain = c.rlike(ASCII)
    d = d.select("doc_id", md5(c).alias("text_key"), plain.alias("plain"), F.when(plain, _native(c)).alias("n"), _keys_udf(F.when(~plain, c)).alias("k"))
    pick = lambda native, other: F.when(F.col("plain"), md5(native)).otherwise(F.col(other))
    return d.select("doc_id", "text_key", pick(F.lower("n"), "k.form").alias("form_key"), pick(F.col("n"), "k.look").alias("look_key")).distinct()


def lookalike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ in code points but look the same.

    Documents meet on the comparison form; the form with case is the exact check that follows. A form with one text
    only (whatever the number of its copies) is left before any pair is built."""
    m = materialize(lookalike_classes(df, doc_id, text), "looks")
    several = m.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo <> hi").select("form_key")
    m = m.join(several, "form_key", "left_semi")
    a, b = m.alias("a"), m.alias("b")
    return a.join(
        b,
        (F.col("a.form_key") == F.col("b.form_key")) & (F.col("a.look_key") == F.col("b.look_key")) & (F.col("a.text_key") != F.col("b.text_key")) & (F.col("a.doc_id") < F.col("b.doc_id")),
    ).select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))


def lookalike_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_texts): one row a document whose text looks like another text; ``class_id`` is the smallest document of its
    class and ``n_texts`` the number of different texts in it. The linear form of ``lookalike_pairs``; counted on (look, text) first, so that
    copies of one text are one row when they meet."""
    m = materialize(lookalike_classes(df, doc_id, text), "looks")
    texts = m.groupBy("look_key", "text_key").agg(F.min("doc_id").alias("d"))
    several = texts.groupBy("look_key").agg(F.min("d").alias("class_id"), F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return m.select("doc_id", "look_key").join(several, "look_key").select("doc_id", "class_id", "n_texts").distinct()
