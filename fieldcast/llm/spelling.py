"""Spelling variants: each frequent word meets the words one edit away from it.

Words are counted where the texts lie, a task sending each distinct word of a bounded stretch
once. Frequent words, in code-point order, are cut into ranges of bounded size; a task builds
each range's compact trie: nodes numbered level by level, so a node's children are a slice of
one string of labels. Shards of the trie are broadcast in turns of bounded size. A word's
distance-one Levenshtein automaton has two rows of states, no error yet and one error made; it
runs through a shard depth-first: along the word itself while no error is made, and at each
node on that path down every branch that the one error opens, which the rest of the word must
then spell out exactly. A shard that holds nothing near ends within a few nodes. What a shard
says of a word is one row: how many neighbours, and the best one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: What a word is, and one in how many is damaged.
WORD = "[A-Za-zÀ-ÿ]+"
DAMAGE = 199

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form has at least so many times the word's occurrences.
MIN_RATIO = 5

#: Bounds: words of a trie, bytes of tries that are broadcast at once, distinct words that a task holds.
SHARD_WORDS = 250_000
BROADCAST_BYTES = 64 << 20
HELD_WORDS = 400_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_TRIE = "words long, labels string, starts binary, counts binary"
_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

Trie = tuple[str, array, array]


# ---- words and their counts


def damaged(word: str, state: int) -> str:
    """``word`` without one code point, for one in ``DAMAGE`` (text, word) pairs. ``state`` is
    the CRC-32 of the text's id and a colon."""
    h = zlib.crc32(word.encode(), state)
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(min_length: int):
    runs = re.compile(WORD)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTS)
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                # bytes.lower() changes A-Z alone
                words = Counter(runs.findall(text.as_py().encode().lower().decode()))
                state = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for word, n in words.items():
                    word = damaged(word, state)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield sent()
        yield sent()

    return counted


def frequent_words(docs: DataFrame, id_col: str, text_col: str, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n``: words of whole texts, lower-cased in A-Z, at least so long and so frequent."""
    rows = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted(min_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- tries


def build_trie(words: list[str], counts: list[int]) -> Trie:
    """The trie of sorted distinct words: (labels, starts, counts) by node, numbered by level.

    Children of node ``i`` are nodes ``starts[i]`` to ``starts[i + 1]``; ``labels`` has the code
    point that leads to each; ``counts`` is 0 where no word ends.
    """
    labels, starts, ends = ["\0"], array("i"), array("q", [0])
    level, depth = [(0, len(words))], 0
    made = 1
    while level:
        below = []
        for lo, hi in level:
            starts.append(made)
            if lo < hi and len(words[lo]) == depth:
                lo += 1  # the word that ends here
            while lo < hi:
                c, at = words[lo][depth], lo
                while at < hi and words[at][depth] == c:
                    at += 1
                labels.append(c)
                ends.append(counts[lo] if len(words[lo]) == depth + 1 else 0)
                below.append((lo, at))
                made += 1
                lo = at
        level, depth = below, depth + 1
    starts.append(made)
    return "".join(labels), starts, ends


def _tries(shard_words: int):
    def tries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[str] = []
        counts: list[int] = []

        def made() -> pd.DataFrame:
            labels, starts, ends = build_trie(words, counts)
            out = pd.DataFrame({"words": [len(words)], "labels": [labels], "starts": [starts.tobytes()], "counts": [ends.tobytes()]})
            words.clear()
            counts.clear()
            return out

        for frame in frames:
            for word, n in zip(frame["word"], frame["n"]):
                words.append(word)
                counts.append(int(n))
                if len(words) >= shard_words:
                    yield made()
        if words:
            yield made()

    return tries


def neighbours(word: str, trie: Trie) -> dict[str, int]:
    """Words of the trie exactly one inserted, deleted or replaced code point away, with counts."""
    labels, starts, ends = trie
    find = labels.find
    found: dict[str, int] = {}
    size = len(word)

    def spelled(node: int, at: int) -> int:
        """Count at the end of the path that spells ``word[at:]`` from ``node``; 0 if none."""
        for i in range(at, size):
            node = find(word[i], starts[node], starts[node + 1])
            if node < 0:
                return 0
        return ends[node]

    node = 0
    for at in range(size + 1):
        lo, hi = starts[node], starts[node + 1]
        if at < size:
            c = word[at]
            if n := spelled(node, at + 1):  # c left out
                found[word[:at] + word[at + 1 :]] = n
            after = word[at + 1] if at + 1 < size else ""
            for child in range(lo, hi):
                first, last = starts[child], starts[child + 1]
                x = labels[child]
                if (find(c, first, last) >= 0) and (n := spelled(child, at)):  # x put in
                    found[word[:at] + x + word[at:]] = n
                if x != c and (not after or find(after, first, last) >= 0) and (n := spelled(child, at + 1)):  # c replaced
                    found[word[:at] + x + word[at + 1 :]] = n
            node = find(c, lo, hi)
            if node < 0:
                break
        else:
            for child in range(lo, hi):
                if ends[child]:
                    found[word + labels[child]] = ends[child]
    found.pop(word, None)
    return found


def _search(shards):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = []
        for labels, starts, counts in shards.value:
            s, e = array("i"), array("q")
            s.frombytes(starts)
            e.frombytes(counts)
            tries.append((labels, s, e))
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for trie in tries:
                    if found := neighbours(word, trie):
                        best = min(found, key=lambda w: (-found[w], w))
                        rows.append((word, len(found), found[best], best))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _FOUND.types)], schema=_FOUND)

    return search


def _near(words: DataFrame, shard_words: int, broadcast_bytes: int) -> list[DataFrame]:
    """Written tables of (word, n_near, form_n, form), one for each turn of broadcast shards."""
    spark = words.sparkSession
    total = words.count()
    ranges = words.repartitionByRange(max(1, -(-total // shard_words)), "word").sortWithinPartitions("word")
    tries = materialize(ranges.mapInPandas(_tries(shard_words), _TRIE).withColumn("id", F.monotonically_increasing_id()))
    sizes = tries.select("id", (F.octet_length("labels") + F.octet_length("starts") + F.octet_length("counts")).alias("bytes")).orderBy("id").collect()
    turns: list[list[int]] = []
    room = 0
    for row in sizes:  # a row for each shard
        if row["bytes"] > room:
            turns.append([])
            room = broadcast_bytes
        turns[-1].append(row["id"])
        room -= row["bytes"]
    spread = words.select("word").repartition(max(2 * spark.sparkContext.defaultParallelism, total // 20_000))
    out = []
    for turn in turns:
        held = [(r["labels"], bytes(r["starts"]), bytes(r["counts"])) for r in tries.filter(F.col("id").isin(turn)).collect()]
        shards = spark.sparkContext.broadcast(held)
        out.append(materialize(spread.mapInArrow(_search(shards), "word string, n_near long, form_n long, form string")))
        shards.destroy()
    release(tries)
    return out


def _roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``word``, ``root``: the last word that forms lead to. A form is ``MIN_RATIO`` times as
    frequent, so paths are short and end; each round doubles the steps already joined."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(max_rounds):
        last = up.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = up.join(last, F.col("root") == F.col("_at"), "left")
        up = materialize(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if not up.filter("moved").limit(1).count():
            return up.select("word", "root")
        up = up.select("word", "root")
    raise RuntimeError("forms did not settle")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, min_ratio: int = MIN_RATIO, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each frequent word of ``docs`` with its near words, its form and its root.

    Words are the maximal runs of ``WORD`` in whole texts, A-Z lower-cased, damaged as in
    ``damaged``, of at least ``min_length`` code points and ``min_count`` occurrences. Near words
    differ by exactly one inserted, deleted or replaced code point. The form is the near word of
    largest count (ties: smallest in code-point order) if it has ``min_ratio`` times the word's.

    Returns ``word``, ``form``, ``root`` (the last of the forms, the word itself if it has none),
    ``n``, ``n_near``, ``form_n``. Null texts have no words; a null id counts as an empty text;
    repeated rows count as often as given; very long texts are read whole, one at a time; other
    columns may have any name; an empty table gives an empty result.
    """
    words = materialize(frequent_words(docs, id_col, text_col, min_length, min_count))
    near = None
    for turn in _near(words, shard_words, broadcast_bytes):
        near = turn if near is None else near.unionByName(turn)
    if near is None:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("w"))).alias("best")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    df = words.join(near, "word", "left")
    good = -F.col("best.n") >= min_ratio * F.col("n")
    df = materialize(df.select("word", F.when(good, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, -F.col("best.n")).alias("form_n")))
    roots = _roots(df.filter("form is not null"))
    return df.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
