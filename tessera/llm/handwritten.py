"""Files that nobody wrote by hand: generated, minified, vendored, data as code, lock files (problem 5).

Weak labels come from notices: comments that say, in any of several languages, that a tool made the file, third-party notices and banners,
lock file markers, and names that tools give to files and to folders of foreign code. The notices are hidden from the features (the leading
comment, marker lines and those names are cut away before anything is measured), so a random forest learns what such files look like: compression
ratio, entropies of tokens and characters, identifier lengths, comment density, line shapes, literals, the share of labelled files among those in
folders of the same path below their roots (counted on the other half of the files) and the number of project roots that hold the same body.

The labels are incomplete in both ways: many files without a notice are not hand-written, and the body of a generated or foreign file can look like
any other. So the forest is fitted twice: the second time without the labelled files whose bodies show nothing, and with the unlabelled ones
that the first forest is sure about as positive. A file is reported if it has a notice, if its body is in several project roots
(which by itself says that it is a copy), or if the forest says so. Labels and copies stay decisive because a forest from which notices are hidden
cannot tell a foreign file from a hand-written one by its body (README has the figures).

Two forests are fitted, each on a bounded sample of one half of the files (``SAMPLE`` of each label, chosen by hash), and score the other half;
every file is measured and classified.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import file_texts
from tessera.session import materialize

#: Bound of the labelled sample, for files with and without a notice each.
SAMPLE = 10_000
SEED = 5

#: Unlabelled files added to each folder's, so that few files give no large share.
PRIOR = 20.0
#: From this probability on of the first forest, a file is an example of files not written by hand for the second.
SURE = 0.7

# Notices of tools and of other projects, looked for in comments only.
GENERATED = re.compile(
    r"(?i)\b(?:code|file|source|document)?\s*(?:was\s+)?(?:auto(?:matically)?[- ]?)generated\b|\bgenerated\s+(?:by|from|with|using)\b(?!\s+hand)|@generated\b|<auto-generated|machine[- ](?:written|generated|made)"
    r"|\bautomatically\s+(?:created|produced|written|built)\b|\bdo not (?:edit|modify)(?:\s+(?:it|this file|manually|by hand))?\s*[.!*\"/-]*\s*$|please do not modify|\bregenerate with\b|never (?:edit )?by hand|edit the template|changes will be (?:lost|overwritten)|edits? (?:get|will be|are) (?:overwritten|lost)"
    r"|\bautom[aá]ti(?:sch|quement|camente)\b[^\n]*\b(?:erzeugt|generiert|erstellt|g[ée]n[ée]r[ée]e?|produite?|cr[ée][ée]e?|generad[oa]|cread[oa]|gerad[oa]|criad[oa]|generat[oa]|creat[oa])\b|\b(?:erzeugt|generiert|erstellt|g[ée]n[ée]r[ée]e?|produite?|cr[ée][ée]e?|generad[oa]|cread[oa]|gerad[oa]|criad[oa]|generat[oa]|creat[oa])\s+autom[aá]ti(?:sch|quement|camente)\b"
    r"|\bfichier\b[^\n]*\b(?:produit|g[ée]n[ée]r[ée]|cr[ée][ée])\s+par\b|\bne pas (?:le |la )?(?:modifier|[ée]diter|changer|toucher)\b|\b(?:datei|code)\b[^\n]*\b(?:erzeugt|generiert)\b|\bnicht (?:von hand |manuell )?(?:bearbeiten|[äa]ndern|editieren|ver[äa]ndern)\b"
    r"|\b(?:archivo|fichero|c[óo]digo|arquivo|ficheiro)\b[^\n]*\b(?:generado|producido|creado|gerado|produzido|criado) por\b|\bno (?:lo )?(?:editar|edite|modificar|modifique|cambiar)\b|\bn[ãa]o (?:editar|edite|modificar|modifique|alterar)\b|\bnon modificare\b"
    r"|сгенерирован|не (?:редактировать|изменять)|自动生成|自動生成|请勿(?:修改|编辑)|編集しないで"
)
FOREIGN = re.compile(
    r"(?i)\bSPDX-License-Identifier\b|\bcopyright\s+(?:\(c\)|©|\d{4})|(?:\(c\)|©)\s+\w+[\w ]*\s(?:project|contributors|authors|developers)|all rights reserved|upstream release|\btaken from the\b|\bvendored (?:from|copy)|\bbundled from\b|\bcopied from\b|\bimported from upstream\b|@license\b|\bderived from\b[^\n]*\b(?:project|library|package)\b"
)
# words without one of which, in lower case, no notice stands in a text
NOTICE_WORDS = (
    "generated", "machine", "automat", "automát", "edit", "modify", "regenerate", "by hand", "template", "overwritten", "lost", "erzeugt", "generiert", "erstellt", "fichier", "ne pas", "nicht", "archivo", "fichero", "código", "codigo", "arquivo", "ficheiro",
    "modifi", "cambiar", "alterar", "сгенерирован", "не ", "自动", "自動", "请勿", "編集", "spdx", "copyright", "(c)", "©", "all rights", "upstream", "taken from", "vendored", "bundled from", "copied from", "@license", "derived from",
)
_HINT = re.compile("|".join(map(re.escape, NOTICE_WORDS)))
BANNER = re.compile(r"/\*! *(?:\n[ \t]*\*[ \t]*)?\S[^\n]*\bv?\d+\.\d+|\A\s*/\*! *\S[^\n]*\*/|@preserve\b")
LOCK = re.compile(r'"lockfileVersion"\s*:|^# THIS IS AN AUTOGENERATED FILE|"_meta"\s*:\s*\{\s*"hash"|^\[\[package\]\]$', re.M)
LOCK_WORDS = ('"lockfileVersion"', "AUTOGENERATED FILE", '"_meta"', "[[package]]")
TOOL_NAME = re.compile(
    r"(?i)(?:[.](?:min|bundle|pb|pb\.gw|generated|designer|gen|g|freezed|auto)\.[a-z]+$|[._-](?:pb2?\.(?:js|d\.ts|ts|rb|php|py|pyi|go|cc|h|hpp)|pb2_grpc\.pyi?|grpc\.pb\.[a-z]+|generated\.[a-z]+|autogen\.[a-z]+|bindata\.go|min\.(?:js|css|mjs))$"
    r"|_(?:string|enumer|easyjson)\.go$|^(?:zz_generated|moc_|qrc_|ui_)[\w.]*\.(?:go|cpp|cc|h)$|\.tab\.[ch](?:pp|c)?$|^lex\.yy\.|(?:^|[._-])(?:lock|shrinkwrap)(?:[._-][a-z0-9]+)?\.(?:json|ya?ml)$|\.lock$|^go\.sum$)"
)
TOOL_TYPE = re.compile(r"(?:OuterClass|AutoGen|AutoGenerated|_AutoValue|Grpc)\.(?:java|cs|kt)$|^AutoValue_\w+\.java$")
# names that data in code form often has, but hand-written code too: labels to learn from, not to decide by
DATA_NAME = re.compile(r"(?i)_(?:data|table|blob|bytes)\.[a-z]+$")
FOREIGN_DIR = re.compile(r"/(?:vendor|vendored|third[_-]?party|node_modules|bower_components|external|externals|deps|site-packages|pods|jspm_packages|extern)/", re.I)

_LEAD = re.compile(r"\A(?:﻿?#![^\n]*\n)?\s*(?:/\*.*?\*/|(?://|#(?!include|define|pragma|if|import|region|!?\[))[^\n]*(?:\n|\Z)|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->|\s+)+", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|(?m:^\s*#(?!include|define|pragma|if|else|endif|\[)[^\n]*)|\"\"\".*?\"\"\"", re.S)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")

_NOTE = re.compile(r"^[^\n]*?(?://|/\*|^\s*[#*]|\"\"\"|'''|<!--)[^\n]*", re.M)

FEATURES = [
    "compression", "token_entropy", "char_entropy", "id_mean", "id_std", "id_short", "id_kinds", "comments", "line_mean", "line_max", "line_std", "blank", "space",
    "strings", "string_max", "digits", "numbers", "punctuation", "lines_log", "size_log", "line_repeats", "token_repeats", "is_json", "is_prose", "folder", "roots",
]
#: Features that compare a file with others, not measured on its text.
COMPARED = ("folder", "roots")
_ROW = "file_id long, path string, project_root string, notice int, body_key string, " + ", ".join(f"{f} double" for f in FEATURES if f not in COMPARED)


def _entropy(counts) -> float:
    c = np.fromiter(counts, dtype=np.float64)
    if not len(c):
        return 0.0
    p = c / c.sum()
    return float(-(p * np.log2(p)).sum())


def split_notice(path: str, text: str) -> tuple[int, str]:
    """The notice (1: of a tool, 2: of foreign code, 3: none, but a name that data in code form often has, 0: none) and the text without the
    places that notices stand in."""
    text = text.replace("\r\n", "\n")
    m = _LEAD.match(text)
    lead, body = (m.group(), text[m.end() :]) if m else ("", text)
    name = path.rsplit("/", 1)[-1]
    foreign = bool(FOREIGN_DIR.search(path))
    if path.endswith((".md", ".txt", ".rst")):
        return (2 if foreign else 0), body
    tool = bool(TOOL_NAME.search(name) or TOOL_TYPE.search(name) or BANNER.search(lead)) and not (path.endswith(".rs") and lead.startswith("/*!"))
    if any(w in body for w in LOCK_WORDS) and LOCK.search(body):
        tool, body = True, LOCK.sub("", body)
    notes = lead.split("\n")
    low, done = body.lower(), -1
    for m in _HINT.finditer(low) if len(low) == len(body) else _HINT.finditer(body):  # a comment further down
        if m.start() >= done:
            done = body.find("\n", m.end())
            done = len(body) if done < 0 else done
            line = body[body.rfind("\n", 0, m.start()) + 1 : done]
            if _NOTE.match(line):
                notes.append(line)
    tool = tool or any(GENERATED.search(x) for x in notes)
    foreign = foreign or any(FOREIGN.search(x) for x in notes)
    return (1 if tool else 2 if foreign else 3 if DATA_NAME.search(name) else 0), body


def features(path: str, body: str, uncommented: str | None = None) -> list[float]:
    """``uncommented``: the body without comments, if it is known."""
    raw = body.encode("utf-8", "surrogatepass")
    n = max(len(body), 1)
    kinds = Counter(_TOKEN.findall(body))
    # counted on different tokens, of which there are few
    tokens_n = max(sum(kinds.values()), 1)
    words = {t: c for t, c in kinds.items() if t[0].isalpha() or t[0] in "_$"}
    words_n = max(sum(words.values()), 1)
    lens = np.fromiter((len(w) for w in words), dtype=np.float64) if words else np.zeros(1)
    often = np.fromiter(words.values(), dtype=np.float64) if words else np.ones(1)
    id_mean = float((lens * often).sum() / often.sum())
    lines = body.split("\n")
    widths = np.fromiter((len(x) for x in lines), dtype=np.float64)
    strings = [len(s) for s in _STRING.findall(body)]
    chars = Counter(body)
    digits = sum(chars[c] for c in "0123456789")
    space = sum(chars[c] for c in " \t\n\r")
    comments = len(body) - len(_COMMENT.sub("", body) if uncommented is None else uncommented)
    return [
        len(zlib.compress(raw, 1)) / max(len(raw), 1), _entropy(kinds.values()), _entropy(chars.values()), id_mean, float(np.sqrt((often * (lens - id_mean) ** 2).sum() / often.sum())), float(often[lens <= 2].sum() / often.sum()), len(words) / words_n,
        comments / n, float(widths.mean()), math.log1p(widths.max()), float(widths.std()), sum(not x.strip() for x in lines) / len(lines), space / n,
        sum(strings) / n, math.log1p(max(strings, default=0)), digits / n, sum(c for t, c in kinds.items() if t[0].isdigit()) / tokens_n, sum(c for t, c in kinds.items() if not (t[0].isalnum() or t[0] in "_$")) / tokens_n,
        math.log1p(len(lines)), math.log1p(n), 1 - len(set(lines)) / len(lines), 1 - len(kinds) / tokens_n,
        float(path.endswith(".json")), float(path.endswith((".md", ".txt", ".rst"))),
    ]


def body_key(body: str, uncommented: str | None = None) -> str | None:
    """A digest of the body without comments and white space, so that copies with other line ends, indents or headers are equal; None if nothing is left."""
    key = "".join((_COMMENT.sub("", body) if uncommented is None else uncommented).split()) or "".join(body.split())
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if key else None


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, path, root, text in b[["file_id", "path", "project_root", "text"]].itertuples(index=False, name=None):
            notice, body = split_notice(path, text)
            plain = _COMMENT.sub("", body)
            out.append([i, path, root, notice, body_key(body, plain), *features(path, body, plain)])
        yield pd.DataFrame(out, columns=["file_id", "path", "project_root", "notice", "body_key", *(f for f in FEATURES if f not in COMPARED)])


def _rooted(m: DataFrame) -> DataFrame:
    """``m`` with ``home``: the project root, or, where it is NULL, the longest known root above the path, or the path's first folders."""
    roots = m.select("project_root").filter("project_root is not null").distinct()
    lost = m.filter("project_root is null").select("file_id", F.split("path", "/").alias("p"))
    above = lost.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("project_root"))
    known = above.join(roots, "project_root").groupBy("file_id").agg(F.max_by("project_root", F.length("project_root")).alias("above"))
    home = F.coalesce("project_root", "above", F.array_join(F.slice(F.split("path", "/"), 1, 5), "/"), F.lit(""))
    return m.join(known, "file_id", "left").withColumn("home", home).drop("above")


def measured_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a file: (file_id, project_root, notice, fold, features...). ``roots`` is the number of project roots that hold the same body (at
    least 1; a file of an unknown root belongs to the one above its path), ``folder`` the largest share of labelled files among
    the files of the other fold that lie in a folder of the same path below their roots."""
    m = materialize(file_texts(files, chunks).mapInPandas(_measure, _ROW), "measured")
    m = _rooted(m).withColumn("fold", F.pmod(F.xxhash64("file_id", F.lit(SEED + 1)), F.lit(2)))
    # distinct (body, root) first, so that a body that a third of the files share is counted in small pieces
    shared = m.filter(F.col("body_key").isNotNull()).select("body_key", "home").distinct().groupBy("body_key").agg(F.count(F.lit(1)).cast("double").alias("roots")).filter("roots > 1")
    below = F.when(F.startswith(F.col("path"), F.concat("home", F.lit("/"))), F.substring("path", F.length("home") + 2, F.lit(1 << 30))).otherwise(F.col("path"))
    parts = F.split(below, "/")
    above = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    lies = m.select("file_id", "fold", (F.col("notice") > 0).cast("double").alias("y"), F.explode(above).alias("name"))
    # only names of several files are kept, which halves the table that meets the rows again
    shares = lies.groupBy("name", "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", (1 - F.col("fold")).alias("fold"), (F.col("s") / (F.col("n") + F.lit(PRIOR))).alias("share"))
    folder = lies.join(shares, ["name", "fold"]).groupBy("file_id").agg(F.max("share").alias("folder"))
    m = m.join(shared, "body_key", "left").join(folder, "file_id", "left")
    return m.withColumn("roots", F.coalesce("roots", F.lit(1.0))).withColumn("folder", F.coalesce("folder", F.lit(0.0))).select("file_id", "project_root", "notice", "fold", *FEATURES)


def fit_forest(rows: DataFrame, trees: int = 40, depth: int = 6):
    """The forest of ``rows`` (file_id, y, features), fitted on at most ``SAMPLE`` of each label, the labels weighing the same. None if there is one
    label only."""
    h = F.xxhash64("file_id", F.lit(SEED))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    picked = rows
    for label in (0, 1):
        if n[label] > SAMPLE:
            picked = picked.filter((F.col("y") != label) | (F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n[label])))
    kept = {k: min(v, SAMPLE) for k, v in n.items()}
    weight = F.when(F.col("y") == 1, F.lit(sum(kept.values()) / (2 * kept[1]))).otherwise(F.lit(sum(kept.values()) / (2 * kept[0])))
    picked = picked.select("y", weight.alias("w"), *FEATURES)
    picked = materialize(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(picked).select("y", "w", "x").coalesce(8), "sample")
    return RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=4, subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=SEED).fit(picked)


def _scored(forest, rows: DataFrame) -> DataFrame:
    """``rows`` with the forest's ``probability``; without a forest a labelled file has 1, others 0."""
    if forest is None:
        return rows.withColumn("probability", (F.col("notice") > 0).cast("double"))
    out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("x", "rawPrediction", "prediction")


def classified_files(files: DataFrame, chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(file_id, project_root, notice, roots, probability, is_foreign): every file that has chunks; ``is_foreign`` is true with a
    notice of a tool or of foreign code, in several roots, or with a probability of at least ``threshold``. Empty tables give an empty result."""
    m = materialize(measured_files(files, chunks), "features")
    out = None
    for k in (0, 1):
        # a file is scored by the forest that did not see it, else files without a notice would be learnt as hand-written by heart
        own, other = m.filter(F.col("fold") == k), m.filter(F.col("fold") != k)
        first = fit_forest(other.withColumn("y", (F.col("notice") > 0).cast("double")))
        forest = first
        if first is not None:
            # labelled files whose bodies show nothing teach nothing; unlabelled ones that show it clearly are no examples of hand-written ones
            sure = _scored(first, other).withColumn("y", F.when(F.col("probability") >= SURE, 1.0).when((F.col("notice") == 0) & (F.col("probability") < 0.5), 0.0))
            forest = fit_forest(sure.filter("y is not null").drop("probability")) or first
        p = _scored(forest, own).select("file_id", "project_root", "notice", "roots", "probability")
        out = p if out is None else out.unionByName(p)
    return out.withColumn("is_foreign", F.col("notice").isin(1, 2) | (F.col("roots") > 1) | (F.col("probability") >= threshold))
