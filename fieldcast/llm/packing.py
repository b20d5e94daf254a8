"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

Tokens are made and counted where the documents lie; only numbers travel. The plan needs the
count of pieces for each length (``capacity`` rows at most, whatever the corpus), so best-fit
decreasing runs over counts. Pieces then take the planned slots by joining on their rank
within their length. The rank is made in two steps, a count for each (length, salt) and a
row number within it; a length has as many salts as its count asks for, so one that a third
of all pieces share is no single group.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
END_ID = 1
#: Rows of one length are ranked in salts of about so many rows.
_SALTED_ROWS = 20_000
_CACHED = 1_200_000
_ASCII_WORDS = re.compile(r"[^ \t-\r]+")

#: The run pattern of the vocabulary that the fast path knows, and the same
#: pattern over plain text. Plain are characters whose normal form and lower case do not
#: depend on their neighbours and that are letters, 0-9, marks or ASCII white space.
RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017e]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f\u0131-\u017f"
_RUNS = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|\d|[^\s{_LETTERS}\d]+")


class RunIds(dict):
    """Lower-case run of a text -> its ids as little-endian uint32 bytes.

    The tokenizer lowers a text, splits it into runs (of letters, of marks, single digits)
    and drops white space; each run is then segmented alone. So a plain text's ids are its
    runs' ids one after the other. Runs come back, so they are kept in a bounded table that
    starts anew when full; a new one goes to the tokenizer's own model, in the byte alphabet
    that its byte-level step would make. Texts that are not plain go to the tokenizer word
    by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        known = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        if not known or steps[0]["pattern"] != {"Regex": RUN_PATTERN} or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("the vocabulary must lower texts, split them by the known pattern and drop white space")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        self.alphabet = {b: chr(b) if b in seen else chr(next(rest)) for b in range(0x100)}

    def __missing__(self, run: str) -> bytes:
        spelled = run.encode("utf-8").decode("latin-1").translate(self.alphabet)
        out = array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()
        if len(run) <= 64:
            if len(self) >= _CACHED:
                self.clear()
            self[run] = out
        return out

    def of(self, text: str) -> bytes:
        """The ids of a whole text."""
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.__getitem__, _RUNS.findall(text.lower())))
        parts = []
        for word in _ASCII_WORDS.findall(text):
            if _PLAIN.fullmatch(word) and not self.special.search(word):
                parts += map(self.__getitem__, _RUNS.findall(word.lower()))
            else:
                parts.append(array("I", self.encoder.encode(word, add_special_tokens=False).ids).tobytes())
        return b"".join(parts)


_kept: dict[str, RunIds] = {}


def run_ids(path: str) -> RunIds:
    """One table for each worker process and vocabulary."""
    if path not in _kept:
        _kept[path] = RunIds(path)
    return _kept[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document's pieces.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut every
    ``capacity`` ids. Null text counts as empty.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = run_ids(tokenizer_path).of
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = ids_of(texts[i].as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: count}``.

    Each row (length, first_rank, n, per_sequence, first_sequence, offset) says: the pieces
    ``first_rank`` to ``first_rank + n - 1`` of this length fill sequences from
    ``first_sequence`` on, ``per_sequence`` in each, from ``offset``. Lengths go from the
    longest down; each takes the sequences with the least sufficient room first, and as
    many fit into one as its room allows, which is what best-fit does piece by piece.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, made = [], 0

    def put_back(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(sizes, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence of {capacity} holds a piece of {length}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                space = sizes[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], sizes[at]
            else:
                space, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            per = space // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, per, first, capacity - space))
                put_back(space - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                out.append((length, rank, left, left, first, capacity - space))
                put_back(space - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put_back(space, first, n)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every piece of every row of ``docs`` in a sequence of at most ``capacity`` tokens.

    Returns ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``; a sequence's pieces lie gapless from offset 0. Null and empty texts are one
    piece, the end id. Repeated rows, also with one id, are packed each; rows with a null id
    too. Other columns are not read. An empty table gives an empty result. Which of several
    pieces of one length takes which slot follows id, piece and checksum, so a task that
    runs again decides alike.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    pieces = materialize(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = spark.createDataFrame([(length, 1 + n // _SALTED_ROWS) for length, n in histogram.items()], "length long, salts long")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place"))
    slots = plan_slots(histogram, capacity)
    plan = spark.createDataFrame(slots, "at_length long, first_rank long, n long, per long, first_sequence long, at long")
    if len(slots) <= 200_000:  # some 10 MB; the number follows capacity, not the corpus
        plan = F.broadcast(plan)
    held = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(plan, held).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"),
    )
