"""A Merkle manifest of a dataset: a root for all rows, and for each row a proof.

A row's leaf is the SHA-256 of its named columns, made by Spark where the row lies; from there
on only digests move. Leaves are numbered in each tree (a value of ``tree_col``) and dealt to
aligned blocks of ``fanout ** levels`` places. A block is one contiguous numpy matrix of 64-byte
hex digests: it is reshaped by the fanout, its rows are hashed level by level, and siblings are
found by index arithmetic. The tops of blocks are the leaves of the next stage, a block's size
fewer each time, until every tree has one node; the trees' roots then form one more tree.
Back down, each stage adds its siblings to the chain of the block above it, and the leaves'
stage hashes the whole chain into the proof and folds it up to the root again.

So a task holds one block and one chain, whatever a tree's size; the driver holds the number
of rows of the largest tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import materialize

#: Children of a node, and the most leaves of a block (the largest power of the fanout below it).
FANOUT = 2
BLOCK = 4096

_HEX = 64
_NODE = "tree string, pos long, size long, digest string"
_CHAIN = "tree string, pos long, lefts array<string>, rights array<string>, subroot string"


def encoded(columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """Of each column ``-`` if null, else its UTF-8 byte count, ``:`` and its text, joined."""
    texts = [(changed or {}).get(c, F.col(c)).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, _HEX)


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a matrix of digests; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = np.ascontiguousarray(nodes[: whole * fanout]).reshape(whole, fanout * _HEX)
    made = [_sha(r) for r in runs]
    if whole * fanout < len(nodes):
        made.append(_sha(nodes[whole * fanout :].tobytes()))
    return _matrix(made)


def levels_of(digests: list[bytes], size: int, fanout: int, block: int) -> list[np.ndarray]:
    """All levels of a block, leaves first. The block of a tree with more than ``block`` nodes
    always has all its levels, a lone node included; another ends with one node."""
    out = [_matrix(digests)]
    width = 1
    while width < block if size > block else len(out[-1]) > 1:
        out.append(_parents(out[-1], fanout))
        width *= fanout
    return out


def _tops(fanout: int, block: int):
    def tops(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        size = int(frame["size"].iloc[0])
        top = levels_of([d.encode() for d in frame["digest"]], size, fanout, block)[-1]
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "pos": [int(frame["pos"].iloc[0]) // block], "size": [-(-size // block)], "digest": [top.tobytes().decode()]})

    return tops


def _runs(levels: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top: every leaf's run as a matrix of digests, the leaf's place in
    it, and the run's length (index arithmetic on the leaves' numbers)."""
    at = np.arange(len(levels[0]))
    for nodes in levels[:-1]:
        start = at // fanout * fanout
        index = np.minimum(start[:, None] + np.arange(fanout), len(nodes) - 1)
        yield nodes[index], at - start, np.minimum(fanout, len(nodes) - start)
        at = at // fanout


def _sides(levels: list[np.ndarray], fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """Each leaf's siblings, joined, to its left and to its right, level by level."""
    n = len(levels[0])
    lefts: list[list[str]] = [[] for _ in range(n)]
    rights: list[list[str]] = [[] for _ in range(n)]
    for runs, place, length in _runs(levels, fanout):
        for i in range(n):
            lefts[i].append(runs[i, : place[i]].tobytes().decode())
            rights[i].append(runs[i, place[i] + 1 : length[i]].tobytes().decode())
    return lefts, rights


def _chain(frame: pd.DataFrame) -> tuple[list[str], list[str], str]:
    """A block's own chain, and the root of its tree."""
    return list(frame["lefts"].iloc[0]), list(frame["rights"].iloc[0]), frame["subroot"].iloc[0]


def _chains(fanout: int, block: int):
    """Chains of a block's nodes: their siblings in the block, then the block's own chain."""

    def chains(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        lefts, rights = _sides(levels_of([d.encode() for d in nodes["digest"]], int(nodes["size"].iloc[0]), fanout, block), fanout)
        up_left, up_right, subroot = _chain(above)
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "lefts": [x + up_left for x in lefts], "rights": [x + up_right for x in rights], "subroot": subroot})

    return chains


def _proofs(fanout: int, block: int):
    """Proof and folded root of each leaf of a block."""

    def proofs(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = len(rows)
        levels = levels_of([d.encode() for d in rows["digest"]], int(rows["size"].iloc[0]), fanout, block)
        now = _matrix([d.encode() for d in rows["claimed"]])
        proof = [hashlib.sha256() for _ in range(n)]
        every = np.arange(n)
        for runs, place, length in _runs(levels, fanout):
            for i in range(n):
                proof[i].update(runs[i, : place[i]].tobytes() + runs[i, place[i] + 1 : length[i]].tobytes())
            runs[every, place] = now
            now = _matrix([_sha(runs[i, : length[i]].tobytes()) for i in range(n)])
        folded = [x.tobytes() for x in now]
        lefts, rights, subroot = _chain(above)
        upper = [(a.encode(), b.encode()) for a, b in zip(lefts, rights)]
        siblings = b"".join(a + b for a, b in upper)
        for i in range(n):
            proof[i].update(siblings)
            for a, b in upper:
                folded[i] = _sha(a + folded[i] + b)
        return pd.DataFrame({"id": rows["id"], "leaf": rows["digest"], "subroot": subroot, "proof_sha256": [p.hexdigest() for p in proof], "folded_root": [f.decode() for f in folded]})

    return proofs


def _by_block(df: DataFrame, block: int):
    return df.groupBy("tree", F.expr(f"pos div {block}").alias("block"))


def _stages(nodes: DataFrame, largest: int, fanout: int, block: int) -> list[DataFrame]:
    """The nodes of each stage above ``nodes``; the last has one node for each tree."""
    out = []
    while not out or largest > 1:
        nodes = materialize(_by_block(nodes, block).applyInPandas(_tops(fanout, block), _NODE))
        out.append(nodes)
        largest = -(-largest // block)
    return out


def _descend(stages: list[DataFrame], chains: DataFrame, fanout: int, block: int) -> DataFrame:
    """Chains of the lowest of ``stages``, from those of the highest."""
    for nodes in stages[-2::-1]:
        above = chains.groupBy("tree", "pos")
        chains = materialize(_by_block(nodes, block).cogroup(above).applyInPandas(_chains(fanout, block), _CHAIN))
    return chains


def manifest(docs: DataFrame, columns: list[str], id_col: str, tree_col: str, tampered: dict[str, Column] | None = None, tampered_when: Column | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """Leaf, roots and proof of every row of ``docs``, and whether a claimed row fits its root.

    The leaf is the SHA-256 (lower-case hex) of ``columns``, as in ``encoded``. Leaves ascend by
    ``id_col`` in the tree of their ``tree_col``; each run of ``fanout`` consecutive nodes becomes
    the SHA-256 of their joined hex texts until one is left (``subroot``); the last run may be
    shorter, even one node. Trees ascend by ``tree_col``, null first, and give ``root`` likewise.
    Rows for which ``tampered_when`` holds claim a leaf with the columns of ``tampered`` in place
    of their own; ``folded_root`` folds the claimed leaf with the row's siblings.

    Returns ``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings, level
    by level up to the root, left to right), ``folded_root`` and ``verified``.

    Null ids come first; rows with the same id are ordered by their leaf, equal rows as they
    come (their digests are the same). A null tree is a tree. A lone row's leaf is its subroot
    and, if it is the only tree, the root, with the SHA-256 of nothing as its proof. Texts are
    hashed whole; other columns may have any name; an empty table gives an empty result.
    """
    wide = 1
    while wide * fanout <= block:
        wide *= fanout
    tree = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    leaf = F.unhex(F.sha2(encoded(columns), 256))
    other = F.lit(None).cast("binary") if tampered_when is None else F.when(tampered_when, F.unhex(F.sha2(encoded(columns, tampered), 256)))
    # binary digests take half the disk
    leaves = materialize(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf.alias("leaf"), other.alias("other")))
    rows = number_rows(leaves, ["tree"], [F.asc("id"), F.asc("leaf")], name="pos", first=0, total="size")
    rows = rows.select("id", "tree", "pos", "size", F.lower(F.hex("leaf")).alias("digest"), F.lower(F.hex(F.coalesce("other", "leaf"))).alias("claimed"))

    largest = rows.agg(F.max("size")).first()[0] or 0
    stages = _stages(rows.select("tree", "pos", "size", "digest"), largest, fanout, wide)
    trees = materialize(number_rows(stages[-1].select("tree", "digest"), [], [F.asc("tree")], name="pos", first=0, total="size"))
    forest = trees.select(F.lit("").alias("tree"), "pos", "size", "digest")
    upper = _stages(forest, trees.agg(F.max("size")).first()[0] or 0, fanout, wide)
    top = upper[-1].first()
    root = F.lit(top["digest"] if top else None).cast("string")

    none = F.array().cast("array<string>")
    chains = _descend([forest, *upper], upper[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), root.alias("subroot")), fanout, wide)
    chains = chains.select("pos", "lefts", "rights").join(trees.select("tree", "pos", F.col("digest").alias("subroot")), "pos")
    chains = _descend(stages, chains.select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot"), fanout, wide)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
    out = _by_block(rows, wide).cogroup(chains.groupBy("tree", "pos")).applyInPandas(_proofs(fanout, wide), schema)
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
