"""Rule-based document quality with cross-document line frequency, in DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated 3-word windows, made from
array functions in one pass over the text. Across documents: each distinct normalised line is
hashed, the distinct documents that hold it are counted for each host, and lines above the
limit are removed. A document that loses too many of its words that way is rejected.

Exact copies are one document, told by the hash of the whole text: a text with a thousand
copies does not turn its own lines into boilerplate, and the copies don't lift the limit.
A host has at most (its lines per document / ``max_share``) lines over the limit, so these
travel as one bounded array for each host, and documents meet them by their host alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is over the limit in a host if more documents hold it than both of these say.
MAX_LINE_SHARE = 0.01
MIN_LINE_DOCS = 20
#: A document keeps at least this share of its words, or it is depleted.
MIN_KEPT_SHARE = 0.5

_POSITION_BITS = 20


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def line_hash(line: Column) -> Column:
    """Hash of the normalised line: lower case, words joined by one blank."""
    return F.xxhash64(F.lower(F.array_join(words_of(line), " ")))


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _neighbour(s: str, test) -> Column:
    """Elements of the sorted array ``s`` that have an equal neighbour, by ``test``."""
    return F.filter(
        F.transform(F.col(s), lambda x, i: F.when(F.coalesce(test(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(test(x, F.get(s, i + 1)), F.lit(False)), x)),
        lambda x: x.isNotNull(),
    )


def with_text_counts(docs: DataFrame, text: str, position_bits: int = _POSITION_BITS) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.

    Words in repeated windows: the windows' hashes are sorted with their positions in the
    low bits, so equal ones meet, and the words under the positions found are counted. Only
    texts with a repeated window are sorted. Where shortened hashes collide or a text has
    more windows than the low bits number, whole (hash, position) pairs are sorted instead.
    """
    long = lambda c: c.cast("long")
    last = (1 << position_bits) - 1
    df = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines_of(F.col(text)))
    n = F.size("_words")
    df = df.withColumn(
        "_win",
        F.when(n >= 3, F.transform(F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    ).withColumns(
        {
            "n_words": long(n),
            "word_chars": long(F.length(F.array_join("_words", ""))),
            "n_symbols": long(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS))),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        }
    )
    df = df.drop("_words", "_lines", text) if text.startswith("_") else df.drop("_words", "_lines")
    df = df.withColumn("_kinds", F.size(F.array_distinct("_win")))
    repeated = F.col("_kinds") < F.size("_win")
    df = df.withColumn("_short", F.when(repeated, F.sort_array(F.transform("_win", lambda h, i: h.bitwiseAND(F.lit(~last)).bitwiseOR(F.least(long(i), F.lit(last)))))))
    whole = (F.size("_win") <= last) & (F.size(F.array_distinct(F.transform("_win", lambda h: h.bitwiseAND(F.lit(~last))))) == F.col("_kinds"))
    df = df.withColumn("_pairs", F.when(repeated & ~whole, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), long(i).alias("i"))))))
    high = lambda a, b: F.shiftright(a, position_bits) == F.shiftright(b, position_bits)
    at = F.when(F.col("_pairs").isNotNull(), F.transform(_neighbour("_pairs", lambda a, b: a["h"] == b["h"]), lambda x: x["i"])).when(
        repeated, F.transform(_neighbour("_short", high), lambda x: x.bitwiseAND(F.lit(last)))
    )
    df = df.withColumn("_at", F.sort_array(F.coalesce(at, F.array().cast("array<bigint>"))))
    gaps = F.transform("_at", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - p, F.lit(3).cast("long"))))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop("_win", "_kinds", "_short", "_pairs", "_at")


def _base(docs: DataFrame, row: Column, text_col: str, host_col: str) -> DataFrame:
    """``row`` of each row of ``docs``, its host, the key of its whole text, counts, and its lines (hash, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row.alias("row"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("key"), text.alias("_text"))
    rows = rows.withColumn("lines", F.transform(lines_of(F.col("_text")), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))))
    rows = with_text_counts(rows, "_text")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def frequent_lines(base: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """``host``, ``gone``: hashes of the lines that more than max(min_docs, max_share of the
    host's documents) distinct documents of the host hold. Hosts without any have no row."""
    docs = base.select("host", "key", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("hs")).distinct()
    # the null line counts the host's documents
    held = docs.select("host", F.explode(F.concat(F.col("hs"), F.array(F.lit(None).cast("bigint")))).alias("h"))
    counts = materialize(held.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("h").isNull() | (F.col("n") > min_docs)))
    size = counts.filter("h is null").select(F.col("host").alias("of"), F.col("n").alias("docs"))
    over = counts.filter("h is not null").join(size, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > max_share * F.col("docs"))
    return over.groupBy("host").agg(F.collect_set("h").alias("gone"))


def _judged(docs: DataFrame, row: Column, text_col: str, host_col: str, max_share: float, min_docs: int, min_kept: float) -> DataFrame:
    base = materialize(_base(docs, row, text_col, host_col))
    over = materialize(frequent_lines(base, max_share, min_docs)).withColumnRenamed("host", "of")
    df = base.join(over, F.col("host").eqNullSafe(F.col("of")), "left")
    hit = F.array_intersect(F.transform("lines", lambda x: x["h"]), F.coalesce("gone", F.array().cast("array<bigint>")))
    df = df.withColumn("hit", hit)
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains(F.col("hit"), x["h"]), x["n"]).otherwise(0))
    df = df.withColumn("words_left", F.col("n_words") - lost)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_kept * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float = MAX_LINE_SHARE, min_docs: int = MIN_LINE_DOCS, min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """Counts and verdict, one row per row of ``docs``.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``words_left`` (after the lines over
    the limit). Null and blank texts have no words and fail. A null host is one host of its
    own. Each row is judged by itself, whatever its id: null and repeated ids are fine, and
    repeated rows come back as often as given. Texts of any length are read whole. Other
    columns are not read. An empty table gives an empty result.
    """
    df = _judged(docs, F.struct(F.col(id_col).alias("id")), text_col, host_col, max_share, min_docs, min_kept)
    return df.select(F.col("row.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_share: float = MAX_LINE_SHARE, min_docs: int = MIN_LINE_DOCS, min_kept: float = MIN_KEPT_SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns, without the lines over the limit.

    Texts without such lines stay byte for byte as they are; of others the remaining lines
    keep their order. Rows are carried through whole, so ids may be null or repeated and
    columns may have any name; null texts are not kept; an empty table gives an empty result.
    """
    df = _judged(docs, F.struct("*"), text_col, host_col, max_share, min_docs, min_kept).filter("kept")
    text = F.col("row").getField(text_col)
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("hit"), line_hash(x))), "\n")
    return df.select(F.when(F.size("hit") > 0, left).otherwise(text).alias("left"), "row").select(*[F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
