"""Fingerprints of texts that tell how two versions differ: invertible Bloom lookup sketches.

A text's paragraphs become a set of 64-bit digests: 48 bits of hash, 16 bits that prove it. A
sketch is a row of small tables; each digest goes to one table by its highest bits and there to
four cells, one of each quarter, and a cell keeps the number and the exclusive or of its digests.
Subtracting two sketches cell by cell leaves the digests that only one version has. A cell with
one of them shows it whole (its 16 bits prove it): it is taken out of its four cells, which
lays others bare, until nothing is left. A table in which too much differs gets stuck; then both
versions' digests of that table are sketched again with twice the cells (two tables, by one more
bit, other bits choosing the cells), then with eight times, then 32 times. What is still stuck after three such
turns (some in ten thousand tables of unrelated texts) is compared as sets.

All of it are column functions over the arrays of a row, in time in proportion to the text,
since a table holds a bounded number of digests. Texts move once, to meet what their neighbour
in the order of ids sends: as much of its beginning as they ask for, and its digests.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import materialize

#: Words of a paragraph, and code points of a word, beyond which it goes on as another one.
MAX_WORDS = 32
MAX_WORD = 60
#: Digests of a table of the published sketch, at most, on average; quarters of a table and their cells.
TABLE = 16
QUARTERS = 4
CELLS = 8

_PROOF = 16  # low bits of a digest that prove the rest
_FIRST = 16  # lowest of the twelve bits that choose a digest's cells
#: For each turn when peeling gets stuck: lowest bit and number of bits that cut the table, lowest bit for cells.
RETRIES = ((28, 1, 30), (42, 3, 46), (28, 5, 34))
_LONG = "bigint"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _fixed(values: list, kind: str) -> Column:
    """Python values as one literal (Spark folds the parse away)."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _halving() -> Column:
    return _fixed([1 << k for k in range(30, -1, -1)], "array<int>")


def _and(x: Column, mask: Column | int) -> Column:
    return x.bitwiseAND(mask if isinstance(mask, Column) else F.lit(mask).cast(_LONG))


def paragraphs(text: Column) -> Column:
    """Lines of a text that hold a word; long ones are cut after every ``MAX_WORDS`` words."""
    word = f"\\S{{1,{MAX_WORD}}}"
    return F.regexp_extract_all(text, F.lit(f"{word}(?:[^\\S\\n]*{word}){{0,{MAX_WORDS - 1}}}"), F.lit(0))


def _proof(high: Column) -> Column:
    return _and(F.xxhash64(high), (1 << _PROOF) - 1)


def digests(text: Column) -> Column:
    """Sorted digests of a text's paragraphs; those of repeats tell which repeat it is."""

    def numbered(s: Column) -> Column:
        def digest(x: Column, repeat: Column) -> Column:
            return _let(F.shiftrightunsigned(F.xxhash64(x, repeat), _PROOF), lambda z: F.shiftleft(z, _PROOF).bitwiseOR(_proof(z)))

        def repeat_of(x: Column, i: Column) -> Column:
            # equal ones are neighbours: how far back they reach, by halving steps
            back = F.aggregate(_halving(), F.lit(0), lambda d, p: F.when(F.get(s, i - d - p) == x, d + p).otherwise(d))
            return F.when(F.get(s, i - 1) == x, back).otherwise(F.lit(0))

        return F.sort_array(F.transform(s, lambda x, i: digest(x, repeat_of(x, i))))

    return _let(F.sort_array(F.transform(paragraphs(text), lambda p: F.xxhash64(p))), numbered)


def table_bits(n: Column) -> Column:
    """Binary logarithm of the number of tables for so many digests."""
    return F.ceil(F.log2(F.greatest(n, F.lit(TABLE)) / F.lit(TABLE))).cast("int")


def _parts(e: Column, bits: Column) -> Column:
    """Sorted digests by their highest ``bits`` bits, as slices."""

    def below(s: Column) -> Column:
        """How many digests come before slice ``s``, by halving steps."""
        first = F.call_function("shiftleft", (s - F.call_function("shiftleft", F.lit(1).cast(_LONG), bits - 1)), 64 - bits)
        all_of = s == F.call_function("shiftleft", F.lit(1).cast(_LONG), bits)
        found = _let(first, lambda t: F.aggregate(_halving(), F.lit(0), lambda d, p: F.when(F.get(e, d + p - 1) < t, d + p).otherwise(d)))
        return F.when(all_of, F.size(e)).otherwise(found)

    last = F.call_function("shiftleft", F.lit(1).cast(_LONG), bits) - 1
    ends = F.transform(F.sequence(F.lit(0).cast(_LONG), last), lambda s: F.struct(below(s).alias("lo"), below(s + 1).alias("hi")))
    return F.when(bits == 0, F.array(e)).otherwise(F.transform(ends, lambda r: F.slice(e, r["lo"] + 1, r["hi"] - r["lo"])))


def _cells(first: int) -> Column:
    """Of each cell of a table the bits that it looks at, and their value."""
    places = [(first + 3 * quarter, i) for quarter in range(QUARTERS) for i in range(CELLS)]
    return _fixed([{"mask": (CELLS - 1) << shift, "value": i << shift} for shift, i in places], "array<struct<mask bigint, value bigint>>")


def _table(part: Column, first: int = _FIRST) -> Column:
    """The cells of a table: number and exclusive or of the digests in each."""
    xor = lambda f: F.aggregate(f, F.lit(0).cast(_LONG), lambda a, x: a.bitwiseXOR(x))
    held = lambda c: F.filter(part, lambda e: _and(e, c["mask"]) == c["value"])
    return F.transform(_cells(first), lambda c: _let(held(c), lambda f: F.struct(F.size(f).alias("n"), xor(f).alias("key"))))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key")))


def _peeled(cells: Column, first: int = _FIRST) -> Column:
    """Digests that a difference of tables holds on either side; null if it gets stuck."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("gone"), none.alias("came"), F.lit(False).alias("done"))

    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (_and(c["key"], (1 << _PROOF) - 1) == _proof(F.shiftrightunsigned(c["key"], _PROOF)))

    def without(s: Column, p: Column) -> Column:
        cells = F.zip_with(s["cells"], _cells(first), lambda c, m: F.when(_and(p["key"], m["mask"]) == m["value"], F.struct((c["n"] - p["n"]).alias("n"), c["key"].bitwiseXOR(p["key"]).alias("key"))).otherwise(c))
        gone = F.when(p["n"] > 0, F.concat(s["gone"], F.array(p["key"]))).otherwise(s["gone"])
        came = F.when(p["n"] < 0, F.concat(s["came"], F.array(p["key"]))).otherwise(s["came"])
        return F.struct(cells.alias("cells"), gone.alias("gone"), came.alias("came"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        stop = F.struct(s["cells"].alias("cells"), s["gone"].alias("gone"), s["came"].alias("came"), F.lit(True).alias("done"))
        return F.when(s["done"], s).otherwise(_let(F.get(F.filter(s["cells"], pure), F.lit(0)), lambda p: F.when(p.isNull(), stop).otherwise(without(s, p))))

    steps = F.sequence(F.lit(0), F.lit(QUARTERS * CELLS))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0))
    return F.aggregate(steps, start, step, lambda s: F.when(~left(s), F.struct(s["gone"].alias("gone"), s["came"].alias("came"))))


def _again(x: Column, y: Column, low: int, bits: int, first: int) -> Column:
    """Digests that differ, from tables cut by ``bits`` more bits; null if one gets stuck."""
    mask = ((1 << bits) - 1) << low
    value = _fixed([q << low for q in range(1 << bits)], "array<bigint>")
    of = lambda part, v: F.filter(part, lambda e: _and(e, mask) == v)
    found = F.transform(value, lambda v: _peeled(_minus(_table(of(x, v), first), _table(of(y, v), first)), first))
    joined = lambda f: F.struct(F.flatten(F.transform(f, lambda r: r["gone"])).alias("gone"), F.flatten(F.transform(f, lambda r: r["came"])).alias("came"))
    return _let(found, lambda f: F.when(~F.exists(f, lambda r: r.isNull()), joined(f)))


def differences(a: Column, b: Column, bits: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """``gone``, ``came``: digests that only ``a`` or only ``b`` has, from their sketches of
    2 ** ``bits`` tables each; tables that get stuck are made again, larger."""
    parts = F.arrays_zip(_parts(a, bits).alias("a"), _parts(b, bits).alias("b"), sketch_a.alias("s"), sketch_b.alias("t"))

    def of(r: Column) -> Column:
        x, y = r["a"], r["b"]
        plain = F.struct(F.array_except(x, y).alias("gone"), F.array_except(y, x).alias("came"))
        return F.coalesce(_peeled(_minus(r["s"], r["t"])), *[_again(x, y, *r) for r in RETRIES], plain)

    found = F.transform(parts, of)
    return _let(found, lambda f: F.struct(F.flatten(F.transform(f, lambda r: r["gone"])).alias("gone"), F.flatten(F.transform(f, lambda r: r["came"])).alias("came")))


def sketch(e: Column, bits: Column) -> Column:
    """2 ** ``bits`` tables of cells over sorted digests."""
    return F.transform(_parts(e, bits), lambda p: _table(p))


def likeness(n_a: Column, difference: Column) -> Column:
    """Share of common paragraphs among all of both versions; 1 if neither has any."""
    gone, all_of = F.size(difference["gone"]), n_a + F.size(difference["came"])
    return F.when(all_of == 0, F.lit(1.0)).otherwise((n_a - gone) / all_of)


def _written_out(text: Column, n: Column, tables: Column) -> Column:
    """A fingerprint as text: number of paragraphs, hash of the text, cells."""
    cell = lambda c: F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["key"]))
    return F.concat_ws("-", n.cast("string"), F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.lower(F.array_join(F.transform(F.flatten(tables), cell), ",")))


def _compared(df: DataFrame, other: str, name: str) -> DataFrame:
    """Add ``name``: likeness of ``own`` to the digests ``other``."""
    bits = F.greatest(F.col("own_bits"), table_bits(F.size(other)))
    df = df.withColumn("_bits", bits)
    a = F.when(F.col("_bits") == F.col("own_bits"), F.col("own_sketch")).otherwise(sketch(F.col("own"), F.col("_bits")))
    known = f"{other}_sketch" in df.columns
    b = sketch(F.col(other), F.col("_bits"))
    b = F.when(F.col("_bits") == F.col(f"{other}_bits"), F.col(f"{other}_sketch")).otherwise(b) if known else b
    df = df.withColumn("_a", a).withColumn("_b", b).withColumn("_d", differences(F.col("own"), F.col(other), F.col("_bits"), F.col("_a"), F.col("_b")))
    return df.withColumn(name, likeness(F.size("own"), F.col("_d"))).drop("_bits", "_a", "_b", "_d")


def _sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name`` (digests of ``text``), its ``_bits`` and ``_sketch``."""
    df = df.withColumn(name, digests(F.col(text))).withColumn(f"{name}_bits", table_bits(F.size(name)))
    return df.withColumn(f"{name}_sketch", sketch(F.col(name), F.col(f"{name}_bits")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text of ``docs`` and of its edited text, and how alike they are.

    The edited text has, in place of the last quarter (floor) of the code points, the first as
    many, or all, of the next row's text by ascending ``id_col``; the last row's next is the
    first.

    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``: likenesses are shares of common paragraphs, repeats counted,
    from 0 to 1, exact but for equal hashes. Null texts are empty; two texts without a word are alike. Null
    ids come first, rows of one id are ordered by a hash of their text, equal rows follow each
    other (each but the last has itself as the next). Texts are read whole, whatever their
    length; other columns may have any name; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = ["k", "h"]
    rows = rows.select("id", "text", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), F.xxhash64(F.col("id").isNull(), "text").alias("h"))

    order = rows.select("id", *key, F.length("text").alias("n")).groupBy(*key).agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    order = materialize(number_rows(order, [], [F.asc("id"), F.asc("h")], name="pos", first=0, total="total"))
    quarter = F.shiftright("n", 2)
    ahead = order.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), quarter.alias("take"), ((F.col("pos") + 1) % F.col("total")).alias("pos"))
    ahead = materialize(order.select(*key, "pos").join(ahead, "pos").drop("pos"))

    texts = rows.select(*key, "text").groupBy(*key).agg(F.first("text").alias("text"))
    sent = texts.join(ahead, key).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("take")).alias("begins"), digests(F.col("text")).alias("next"))
    df = texts.join(order.select(*key, "id", F.col("n").cast("long").alias("n_chars"), quarter.alias("take"), "copies"), key).join(sent, key)
    df = _sketched(df, "text", "own")
    once = F.struct("begins", "next", F.lit(1).cast(_LONG).alias("times"))
    more = F.struct(F.substring(F.col("text"), F.lit(1), F.col("take")).alias("begins"), F.col("own").alias("next"), (F.col("copies") - 1).alias("times"))
    df = df.withColumn("_case", F.explode(F.when(F.col("copies") > 1, F.array(once, more)).otherwise(F.array(once)))).drop("begins", "next").select("*", "_case.*")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), F.col("begins")))
    df = _sketched(df, "edited", "changed")
    df = _compared(_compared(df, "changed", "near_edited"), "next", "near_next")
    df = df.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _written_out(F.col("text"), F.size("own"), F.col("own_sketch")).alias("fingerprint"),
        _written_out(F.col("edited"), F.size("changed"), F.col("changed_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "times",
    )
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast(_LONG), F.col("times")))).drop("times", "_copy")
