"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into transducers. The normaliser rewrites the longest match of its
character map at each place (the map is a compiled automaton in the file), squeezes blanks,
puts the dummy blank in front and escapes blanks. The lexicon reads a piece's characters and
writes its id, with a weight. Byte fallback reads a character that is in no piece and writes
its bytes' ids. An input is composed with them from left to right, and its encoding is the
shortest path in the tropical semiring (weights add along a path, the least total wins).

For unigram models an arc's weight is minus the piece's score. For BPE models it depends on
the arc before, which is the composed machine's state: 0 if merging would leave the two pieces
side by side, infinite if not (:mod:`.merges`). Then one path alone is finite for each
beginning of a text, so keeping the best arc into each place loses nothing.

User-defined symbols are cut out first, the longest at each place. Where no piece holds a
blank after another character, a text's path is that of its blank-led words one after the
other; new words are searched in the order of the words, so that the work on common
beginnings is done once. Paths of short words are kept in a bounded table.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import INFINITE, MergeLattice

BLANK = "▁"
_CACHED, _KEPT_CHARS = 800_000, 64
_WEIGHTS = 600_000
_FIELDS = {"pieces": 1, "trainer": 2, "normalizer": 3}
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed value: how much worse than the least piece an unknown character is.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = data[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The normaliser's settings and its character map.

    The map is a double array: a state is a place in ``units``; reading a byte moves to the
    place that the unit's offset and the byte give, if the unit there bears that byte. Units
    with a leaf lead to the place of their output in ``outputs``.
    """

    def __init__(self, spec: dict[int, int | bytes], symbols: re.Pattern | None):
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.symbols = symbols
        blob = spec.get(2, b"")
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.outputs = blob[4 + size :]
        self.known: dict[int, str] = {}
        # ASCII characters that neither alone nor with another ASCII character begin a match
        inert = [c for c in range(128) if self.units and not any(self._match(bytes([c, d]), 0) for d in range(128))]
        self.plain = re.compile(b"[" + re.escape(bytes(inert)) + rb"]+(?=[\x00-\x7f]|\Z)") if inert else None

    def _match(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length and output of the longest match at ``at``."""
        units, n, found = self.units, len(self.units), None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        place = offset(units[0])
        for k in range(at, len(data)):
            place ^= data[k]
            if place >= n or units[place] & 0x800000FF != data[k]:
                break
            unit = units[place]
            place ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[place] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        if start not in self.known:
            self.known[start] = self.outputs[start : self.outputs.index(0, start)].decode("utf-8")
        return length, self.known[start]

    def _rewrite(self, text: str) -> str:
        data, out, at = text.encode("utf-8"), [], 0
        while at < len(data):
            if self.plain and (run := self.plain.match(data, at)):
                out.append(run[0].decode())
                at = run.end()
            elif hit := self._match(data, at):
                out.append(hit[1])
                at += hit[0]
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + size].decode("utf-8"))
                at += size
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.units:
            parts = self.symbols.split(text) if self.symbols else [text]
            text = "".join(part if i % 2 else self._rewrite(part) for i, part in enumerate(parts))
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text


class Transducer:
    """Compiled from the bytes of a model file."""

    def __init__(self, model: bytes):
        pieces, scores, kinds = [], [], []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for field, value in _fields(model):
            if field == _FIELDS["pieces"]:
                p = dict(_fields(value))
                pieces.append(p[1].decode("utf-8"))
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif field == _FIELDS["trainer"]:
                trainer = dict(_fields(value))
            elif field == _FIELDS["normalizer"]:
                normal = dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        if self.type not in (UNIGRAM, BPE) or trainer.get(24) or (self.type == BPE and UNUSED in kinds):
            raise ValueError("only unigram and BPE models with blanks in front and, for BPE, without unused pieces")
        self.pieces, self.kinds = pieces, kinds
        self.unknown = kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        least, most = min(self.score.values(), default=0.0), max(self.score.values(), default=0.0)
        users = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == USER}
        self.symbols = None
        if users and self.type == BPE:
            self.symbols = re.compile("(" + "|".join(re.escape(p) for p in sorted(users, key=lambda p: (-len(p), p))) + ")")
            self.user = users
        elif users:  # arcs of their own weight among the others
            self.ids |= users
            self.score |= {p: len(p.encode()) * most - 0.1 for p in users}
        matched = re.compile("(" + "|".join(re.escape(p.replace(BLANK, " ")) for p in sorted(users, key=lambda p: (-len(p), p))) + ")") if users else None
        self.normalise = Normaliser(normal, matched)
        self.dummy = self.normalise.dummy
        self.lattice = MergeLattice(self.ids, lambda a, b: -s if (s := self.score.get(a + b)) is not None else None)
        #: Arcs into a place: pieces by their characters from the last to the first; "" holds the piece.
        self.arcs: dict = {}
        for piece in self.ids:
            node = self.arcs
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        #: Weight of an arc by the state before it and its piece; unigram models have one state.
        self.weights: dict[tuple[str, str], float] = {}
        self.fallback_weight = UNKNOWN_PENALTY - least if self.type == UNIGRAM else 0.0
        #: No path weighs less, so an arc that reaches it needs no rival.
        self.floor = 0.0 if self.type == BPE else -INFINITE

        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids) and (bool(self.bytes) or BLANK in self.ids)
        # control characters that no piece holds stand alone too, where bytes keep unknown neighbours apart
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids)) if self.bytes else ""
        self.words = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        self.kept: dict[str, bytes] = {}
        spell = {NORMAL: lambda p: p.replace(BLANK, " ").encode("utf-8"), USER: lambda p: p.replace(BLANK, " ").encode("utf-8"), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " \u2047 ".encode()}
        self.spelled = [spell[k](p) if k in spell else b"" for p, k in zip(pieces, kinds)]

    def _weight(self, before: str, piece: str) -> float:
        """Weight of the arc ``piece`` in state ``before`` (the arc before it; "" at the start)."""
        if self.type == UNIGRAM:
            return -self.score[piece]
        return 0.0 if not before or before not in self.ids or self.lattice.fits(before, piece) else INFINITE

    def shortest_paths(self, texts: Iterable[str]) -> Iterator[list[str]]:
        """The arcs of each text's shortest path through its composition with the lexicon and
        the fallback; a character that is a piece of its own by no arc stands for itself.

        The totals of a beginning don't depend on what follows, so neighbours in ``texts``
        share those of their common beginning. Of equal totals the longest last arc holds.
        """
        arcs, weights, floor, unigram = self.arcs, self.weights, self.floor, self.type == UNIGRAM
        before, total, last = "", [0.0], [""]
        for text in texts:
            n = len(text)
            k = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                k += 1
            del total[k + 1 :], last[k + 1 :]
            for end in range(k + 1, n + 1):
                node, at, best, arc = arcs, end, INFINITE, None
                while at:
                    at -= 1
                    node = node.get(text[at])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is None or total[at] > best:
                        continue
                    state = "" if unigram else last[at]
                    w = weights.get((state, piece))
                    if w is None:
                        if len(weights) >= _WEIGHTS:
                            weights.clear()
                        w = weights[state, piece] = self._weight(state, piece)
                    w += total[at]
                    if w <= best and w < INFINITE:
                        best, arc = w, piece
                        if best <= floor:
                            break
                if text[end - 1] not in self.ids and (w := total[end - 1] + self.fallback_weight) < best:
                    best, arc = w, text[end - 1]
                total.append(best)
                last.append(arc)
            before = text
            out, k = [], n
            while k:
                out.append(last[k])
                k -= len(last[k])
            yield out[::-1]

    def _written(self, path: list[str]) -> bytes:
        ids: list[int] = []
        for p in path:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode("utf-8")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)  # neighbouring unknown characters are one
        return array("I", ids).tobytes()

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of every word: from the table, or by a search that fills it."""
        new = sorted(w for w in words if w not in self.kept)
        if len(self.kept) + len(new) > _CACHED:
            self.kept = {w: self.kept[w] for w in words if w in self.kept}
        found = dict(zip(new, map(self._written, self.shortest_paths(new))))
        if len(self.kept) + len(found) <= _CACHED:
            self.kept.update((w, x) for w, x in found.items() if len(w) <= _KEPT_CHARS)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        normal = [self.normalise(t) for t in texts]
        cut = [self.symbols.split(t) for t in normal] if self.symbols else [[t] for t in normal]
        split = [[self.words.findall(p) if self.by_word else [p] for p in parts[::2]] for parts in cut]
        found = self._ids_of({w for parts in split for words in parts for w in words})
        kept, out = self.kept, []
        for parts, words in zip(cut, split):
            made = [b"".join([found[w] if w in found else kept[w] for w in x]) for x in words]
            for k, symbol in enumerate(parts[1::2]):
                made[k] += struct.pack("<I", self.user[symbol])
            out.append(b"".join(made))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text that was encoded, up to what the normaliser rewrote or took out."""
        text = b"".join(map(self.spelled.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_kept: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process and model."""
    if path not in _kept:
        with open(path, "rb") as f:
            _kept[path] = Transducer(f.read())
    return _kept[path]


def _some(column: pa.Array, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts of a column, some at a time."""
    held: list[str] = []
    size = 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; null and empty texts have none.

    Texts of any length are read whole. Null ids and repeated rows come back as often as
    given; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            made = [ids for texts in _some(batch.column(1)) for ids in t.encode_all(texts)]
            ends = array("i", [0])
            for x in made:
                ends.append(ends[-1] + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(made))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row; null ids give an empty text.

    Repeated rows come back as often as given; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            texts = [t.decode(array("I", x.as_py() or []).tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_ids``, ``ids_crc32`` (unsigned, little-endian 32-bit ids),
    ``n_decoded`` (code points of the decoded text) and ``same`` (it is the text again).

    Null texts count as empty; texts of any length are read whole. Null ids and repeated rows
    come back as often as given; other columns are not read; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for texts in _some(batch.column(1)):
                for text, ids in zip(texts, t.encode_all(texts)):
                    back = t.decode(ids)
                    for column, value in zip(out, (len(ids) // 4, zlib.crc32(ids), len(back), back == text)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["id", "n_ids", "ids_crc32", "n_decoded", "same"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, n_decoded long, same boolean").withColumnRenamed("id", id_col)
