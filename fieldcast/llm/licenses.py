"""Licence scans: notices by TF-IDF cosine to templates, then inheritance down directories.

Comment marks are taken off. A text's passages are its lines, its paragraphs (a comment block
is one, however the code around it runs), their sentences across line breaks, and the whole
text; the sparse TF-IDF vector of each is compared with those of the templates (weights from
the templates' own document frequencies). A passage that has none of a template's signal words
cannot reach the threshold: these are what is left of a template when its commonest and
lightest words, together too light to reach it, are taken away.

Licences that share most of their words are told apart by the few they don't share: version
numbers and words such as *lesser* or *noncommercial* must agree with the template's, and of
templates nearly as similar the one wins whose own words the passage holds. A licence that is
in no template gives none rather than its neighbour; so does a notice that is taken back. An
identifier line that joins several licences gives them all, joined.

A file without a notice inherits from the licence file in the nearest directory above it. Each
distinct directory is joined with the licence files of all its ancestors, the deepest wins, and
files join their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .html_text import STOP_WORDS
from .license_texts import Template, templates

THRESHOLD = 0.7
#: A text of which at least this share of words is notice is a licence file.
FILE_SHARE = 0.25
#: Templates so much less similar than the best still compete by their own words.
NEAR_TIE = 0.15
#: Weight of a word that is in no template.
UNSEEN = 2.5
#: A passage and its template share so many distinct words at least.
MIN_SHARED = 2

_TOKEN = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^a-z\s])")
#: Comment marks of programming and markup languages.
_COMMENT = re.compile(r"\s*(?:#+|//+|/\*+|\*+/?|;+|--+|%+|<!--+|\"{3}|'{3}|(?:REM|rem|dnl)\b)(?!\w)\s*")
_COMMENT_END = re.compile(r"\s*(?:\*+/|--+>|\"{3}|'{3})\s*\Z")
#: Words that tell licences of one family apart, and version numbers.
_FAMILY = {"library-general", "lesser", "affero", "agpl", "lgpl", "agplv3", "lgplv3", "lgplv2.1", "gplv2", "gplv3"}
_PARTS = {"nc": "nc", "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd"}
_VERSION = re.compile(r"v?(\d+(?:\.\d+)?)\Z")
_CC = re.compile(r"(?:cc-)?by(?:-(?:nc|sa|nd))*(?:-\d\.\d)?\Z|attribution(?:-[a-z]+)*\Z")


#: A family name of two words, an identifier line, and what an expression joins.
_LIBRARY = re.compile(r"library\s+general\s+public")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]+)", re.I)
_JOINED = re.compile(r"[()]|\b(?:AND|OR)\b|[A-Za-z0-9.+-]+")
_TAIL = re.compile(r"(?:-only|-or-later|\+)\Z")
#: Words that take a notice back.
_NEGATIONS = {"not", "never", "isn", "aren", "longer"}

#: Words of any text, the first not to be signal words.
_COMMON = frozenset(w for words in STOP_WORDS.values() for w in words.split())


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_LIBRARY.sub("library-general public", text.lower()))


def taken_back(words: list[str]) -> bool:
    """The passage says that something is *not* licensed or released under a licence."""
    for i, w in enumerate(words):
        if w in ("licensed", "released") and "under" in words[i + 1 : i + 3] and not _NEGATIONS.isdisjoint(words[max(0, i - 3) : i]):
            return True
    return False


def expressed(text: str, names: frozenset[str]) -> str | None:
    """The licences of an identifier line that joins several, with their own names, joined as
    they are there; None if there is no such line, or if it names another licence."""
    for line in _SPDX.findall(text):
        parts = _JOINED.findall(line.split("*/")[0].split("-->")[0])
        ids = [_TAIL.sub("", p) for p in parts if p not in ("(", ")", "AND", "OR")]
        if len(ids) > 1 and ("OR" in parts or "AND" in parts):
            if not names.issuperset(ids):
                continue
            if len({p for p in parts if p in ("AND", "OR")}) == 1:
                return f" {'OR' if 'OR' in parts else 'AND'} ".join(dict.fromkeys(ids))
            return re.sub(r"\( | (?=\))", lambda m: m[0].strip(), " ".join(_TAIL.sub("", p) for p in parts))
    return None


def telling(words: Iterable[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The family words and the version numbers among ``words``."""
    family, versions = set(), set()
    for w in words:
        if m := _VERSION.match(w):
            versions.add(m[1])
        elif w in _FAMILY:
            family.add(w)
        elif _CC.match(w):
            family |= {_PARTS[p] for p in w.split("-") if p in _PARTS}
    return frozenset(family), frozenset(versions)


@dataclass(frozen=True)
class Found:
    name: str
    cosine: float
    title: bool


class Matcher:
    """The templates' vectors, and which templates each signal word may lead to."""

    def __init__(self, every: list[Template], threshold: float):
        self.templates, self.threshold = every, threshold
        self.names = frozenset(t.name for t in every)
        bags = [Counter(tokens(t.text)) for t in every]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: math.log((1 + len(bags)) / (1 + c)) + 1 for w, c in df.items()}
        self.vectors: list[dict[str, float]] = []
        self.leads: dict[str, list[int]] = {}
        self.telling = [telling(b) for b in bags]
        for k, bag in enumerate(bags):
            weights = {w: (1 + math.log(n)) * self.idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            vector = {w: x / norm for w, x in weights.items()}
            self.vectors.append(vector)
            left = 0.0
            for w, x in sorted(vector.items(), key=lambda p: (p[0] not in _COMMON, p[1], p[0])):
                left += x * x
                if math.sqrt(left) >= threshold - 1e-9:
                    self.leads.setdefault(w, []).append(k)
        self.signals, self.vocabulary = self.leads.keys(), self.idf.keys()

    def cosines(self, words: list[str]) -> dict[int, float]:
        """Similarity to each template that the passage has a signal word of."""
        bag = Counter(words)
        near = {k for w in self.signals & bag.keys() for k in self.leads[w]}
        if not near or len(self.vocabulary & bag.keys()) < MIN_SHARED:
            return {}
        weights = {w: (1 + math.log(n)) * self.idf.get(w, UNSEEN) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        out = {}
        for k in near:
            shared = [(weights[w], y) for w, y in self.vectors[k].items() if w in weights]
            if len(shared) >= min(MIN_SHARED, len(self.vectors[k])):
                out[k] = sum(x * y for x, y in shared) / norm
        return out

    def _holds(self, k: int, family: frozenset[str], versions: frozenset[str], file: set[str]) -> bool:
        t = self.templates[k]
        own_family, own_versions = self.telling[k]
        if t.other and t.other[0] in file and file.isdisjoint(t.other[1]):
            return False
        return own_family == family and own_versions <= versions and file.issuperset(t.needs) and file.isdisjoint(t.lacks)

    def best(self, words: list[str], file: set[str] | None = None) -> Found | None:
        """The licence of a passage, or None. ``file``: the words of its whole text."""
        got = {k: c for k, c in self.cosines(words).items() if c >= self.threshold}
        if not got or taken_back(words):
            return None
        held = set(words)
        family, versions = telling(held)
        got = {k: c for k, c in got.items() if self._holds(k, family, versions, held if file is None else file)}
        if not got:
            return None
        top = max(got.values())
        first: dict[str, int] = {}  # of each licence its most similar template
        for k, c in sorted(got.items(), key=lambda p: (-p[1], p[0])):
            if c >= top - NEAR_TIE:
                first.setdefault(self.templates[k].name, k)
        near = list(first.values())

        def own_share(a: int, b: int) -> float:
            own = {w: x for w, x in self.vectors[a].items() if w not in self.vectors[b]}
            return sum(x for w, x in own.items() if w in held) / sum(own.values()) if own else 0.5

        wins = {a: sum(own_share(a, b) > own_share(b, a) for b in near if b != a) for a in near}
        k = max(near, key=lambda a: (wins[a], got[a], -a))
        name = self.templates[k].name
        return Found(name, got[k], any(self.templates[j].title for j in got if self.templates[j].name == name))

    def _signalled(self, words: list[str]) -> bool:
        return not self.signals.isdisjoint(words) and len(self.vocabulary & set(words)) >= MIN_SHARED

    def scan(self, text: str) -> tuple[str | None, float, float, bool]:
        """Licence of the best passage, its cosine, the share of words in notices, and
        whether the text holds the beginning of a licence's own text."""
        every = tokens(text) if text else []
        if text and (joined := expressed(text, self.names)):
            return joined, 1.0, 0.0, False
        if not self._signalled(every):
            return None, 0.0, 0.0, False
        file, found, noticed = set(every), [], 0

        def judge(passage: list[str]) -> int:
            got = self.best(passage, file) if self._signalled(passage) else None
            if got:
                found.append(got)
            return len(passage) if got else 0

        for lines in paragraphs(text):
            whole = tokens(" ".join(lines))
            if not self._signalled(whole):
                continue
            by_line = sum(judge(tokens(x)) for x in lines) if len(lines) > 1 else 0
            parts = _SENTENCE.split(" ".join(lines))
            by_sentence = sum(judge(tokens(x)) for x in parts) if len(parts) > 1 else 0
            noticed += max(judge(whole), by_line, by_sentence)
        noticed = max(noticed, judge(every))
        if not found:
            return None, 0.0, 0.0, False
        top = max(found, key=lambda f: f.cosine)  # the first of equals
        return top.name, round(min(top.cosine, 1.0), 9), noticed / len(every), any(f.title for f in found if f.name == top.name)


def paragraphs(text: str) -> Iterator[list[str]]:
    """Runs of lines without an empty one among them, comments apart from what is none."""
    held: list[str] = []
    commented = False
    for line in text.split("\n"):
        mark = _COMMENT.match(line)
        body = _COMMENT_END.sub("", line[mark.end() :] if mark else line).strip()
        if held and (not body or (mark is not None) != commented):
            yield held
            held = []
        if body:
            held.append(body)
            commented = mark is not None
    if held:
        yield held


def find_notices(files: DataFrame, id_col: str, text_col: str, every: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``own`` (licence or null), ``similarity``, ``share``, ``title``, ``path`` of every row."""
    matcher = Matcher(every or templates(), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [matcher.scan(x.as_py() or "") for x in batch.column(1)]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *batch.columns[2:]], names=["id", "own", "similarity", "share", "title", "path"])

    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col("path"))
    return rows.mapInArrow(run, f"id {kind}, own string, similarity double, share double, title boolean, path string")


def parent(path: Column) -> Column:
    """The directory of a path; empty for the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(files: DataFrame) -> DataFrame:
    """Give files without a notice the licence of the nearest licence file above them.

    ``files``: id, path, own, similarity, is_file (a licence file). Of several licence files
    in one directory the most similar holds, then the smallest path, then the smallest id.
    A null path is in the top directory.
    """
    files = files.withColumn("dir", F.coalesce(parent(F.col("path")), F.lit("")))
    best = F.min_by("own", F.struct(-F.col("similarity"), F.col("path"), F.col("id").cast("string")))
    held = files.filter("is_file").groupBy(F.col("dir").alias("above")).agg(best.alias("inherited"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))
    dirs = files.select("dir").distinct().withColumn("above", F.explode(above))
    nearest = dirs.join(held, "above").groupBy("dir").agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("got"))
    df = files.join(nearest, "dir", "left")
    return df.select(
        "id",
        "path",
        F.coalesce("own", "got.inherited").alias("license"),
        F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("got").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("got.above")).alias("license_dir"),
        "similarity",
    )


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD, every: list[Template] | None = None) -> DataFrame:
    """Licence of every row: ``id_col``, ``path``, ``license``, ``origin`` (file, header,
    inherited or null), ``license_dir`` (whose file was inherited) and ``similarity``.

    Null and empty texts have no notice; they inherit. A licence file holds the beginning of a
    licence's own text, or is notice for ``FILE_SHARE`` of its words. Texts of any length are
    read whole, in time in proportion to it. Of several licence files in one directory the
    most similar holds, then the smallest path, then the smallest id. Null ids and repeated
    rows come back as often as given; columns beside the three named are not read; an empty
    table gives an empty result.
    """
    rows = files.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(path_col).alias("path"))
    found = find_notices(rows, "_id", "_text", every, threshold).withColumn("is_file", F.col("own").isNotNull() & (F.col("title") | (F.col("share") >= FILE_SHARE)))
    return inherit(materialize(found)).withColumnRenamed("id", id_col)
