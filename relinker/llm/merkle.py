"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A node's hash is over the hexadecimal hashes of its children. Such a hash is 64 bytes, just one
block of SHA-256, so a parent can keep the state of its hash before each child slot as
eight words. A changed child is folded by resuming that state with the replacement and
the siblings to its right; those to its left are never read again.

Runs of ``FAN ** DEPTH`` neighbouring nodes form chunks, which are built and folded by
themselves in numpy, all nodes of a level at once; the chunks' roots are the nodes of
the next round. So there are few rounds, and no task gets more than a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinker.llm.common import parts, saved, scratch, ship

FAN = 3
#: Levels of a chunk, which so has FAN ** DEPTH nodes at most.
DEPTH = 7


def _root_bits(prime: int, degree: int) -> int:
    """32 bits of the fraction of a prime's root of a degree."""
    want, low, high = prime << (32 * degree), 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**degree <= want else (low, mid)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, p))]
_K = [_root_bits(p, 3) for p in _PRIMES]
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (rows, 8) of SHA-256 after a block (rows, 16) each, as words; all rows at once."""
    w = list(np.ascontiguousarray(blocks.T))
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    before = np.ascontiguousarray(states.T)
    a, b, c, d, e, f, g, h = before
    for word, k in zip(w, _K):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + np.uint32(k) + word
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return (np.stack([a, b, c, d, e, f, g, h]) + before).T


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """The hexadecimal text (64 bytes) of each digest (rows, 8), as a block (rows, 16)."""
    data = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(len(digests), 32)
    text = _HEX[np.stack([data >> 4, data & 15], axis=2).reshape(len(digests), 64)]
    return text.view(">u4").astype(np.uint32)


def _last_blocks(blocks: np.ndarray) -> np.ndarray:
    """Padding after so many whole blocks."""
    out = np.zeros((len(blocks), 16), np.uint32)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    out[:, 0], out[:, 14], out[:, 15] = 0x80000000, (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def to_words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(d) for d in digests), ">u4").reshape(-1, 8).astype(np.uint32)


def to_hex(words: np.ndarray) -> list[str]:
    data = np.ascontiguousarray(words.astype(">u4")).tobytes().hex()
    return [data[i : i + 64] for i in range(0, len(data), 64)]


class Parents:
    """One level of parents: ``before[i, slot]`` is parent i's state before that slot, ``size`` how many children it has."""

    def __init__(self, children: np.ndarray):
        many = -(-len(children) // FAN)
        padded = np.zeros((many * FAN, 8), np.uint32)
        padded[: len(children)] = children
        self.children = padded.reshape(many, FAN, 8)
        self.size = np.minimum(FAN, len(children) - FAN * np.arange(many))
        self.before = np.zeros((many, FAN + 1, 8), np.uint32)
        self.before[:, 0] = START
        for slot in range(FAN):
            there = self.size > slot
            self.before[there, slot + 1] = compress(self.before[there, slot], hex_blocks(self.children[there, slot]))
        self.digests = compress(self.before[np.arange(many), self.size], _last_blocks(self.size))

    def steps(self, at: np.ndarray) -> Steps:
        """What folding the children at these places needs."""
        up, slot = at // FAN, at % FAN
        return Steps(self.before[up, slot], slot, self.size[up], self.children[up])


class Steps:
    """One level of a path for some rows: state before the slot, slot, number of children, children (FAN of them, own place unread)."""

    def __init__(self, before: np.ndarray, slot: np.ndarray, size: np.ndarray, children: np.ndarray):
        self.before, self.slot, self.size, self.children = before, slot, size, children

    def packed(self) -> np.ndarray:
        """As bytes (rows, width)."""
        small = np.stack([self.slot, self.size], axis=1).astype(np.uint8)
        words = np.concatenate([self.before, self.children.reshape(len(small), -1)], axis=1).astype(">u4")
        return np.concatenate([small, np.ascontiguousarray(words).view(np.uint8)], axis=1)

    @staticmethod
    def unpacked(data: bytes, rows: int) -> list[Steps]:
        """The levels of one path, each for all of ``rows`` rows."""
        width = 2 + 32 * (FAN + 1)
        out = []
        for at in range(0, len(data), width):
            words = np.frombuffer(data, ">u4", 8 * (FAN + 1), at + 2).astype(np.uint32)
            all_ = lambda x: np.broadcast_to(x, (rows, *np.shape(x)))
            out.append(Steps(all_(words[:8]), all_(np.int64(data[at])), all_(np.int64(data[at + 1])), all_(words[8:].reshape(FAN, 8))))
        return out

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The parents' digests with these in the slots: resumed from the states before, with right siblings only."""
        state = compress(self.before, hex_blocks(digests))
        for slot in range(1, FAN):
            right = (slot > self.slot) & (slot < self.size)
            if right.any():
                state[right] = compress(state[right], hex_blocks(self.children[right, slot]))
        return compress(state, _last_blocks(self.size))

    def add_siblings(self, state: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash states of proofs, and their numbers of blocks, with this level's siblings, left to right."""
        state = state.copy()
        for slot in range(FAN):
            sibling = (slot != self.slot) & (slot < self.size)
            if sibling.any():
                state[sibling] = compress(state[sibling], hex_blocks(self.children[sibling, slot]))
                blocks = blocks + sibling
        return state, blocks


def _levels(n: int) -> int:
    """Levels over n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _built(digests: np.ndarray, n: int, depth: int) -> list[Parents]:
    """A chunk's levels of parents, of a tree that has n nodes in all."""
    out = []
    for _ in range(min(depth, _levels(n))):
        out.append(Parents(digests))
        digests = out[-1].digests
    return out


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in order) and ``n`` (rows) within each group; no group meets in one task.

    Rows are dealt by range; each partition numbers its own, and a table of a row for each
    group and partition says where these begin. Called in a ``scratch`` block.
    """
    rows = saved(rows).withColumn("tie", F.monotonically_increasing_id())
    keys = [group, *order, "tie"]
    rows = rows.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = saved(rows.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("share", F.shiftright("at", 33)))
    runs = rows.groupBy(group, "share").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    before = Window.partitionBy(group).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("many").over(before), F.lit(0))
    runs = saved(runs.select(group, "share", (base - F.col("first")).alias("base"), F.sum("many").over(Window.partitionBy(group)).alias("n")))
    return rows.join(runs, [group, "share"]).withColumn("place", F.col("base") + F.col("at")).drop("at", "share", "base")


_NODES = "grp string, place long, digest string, n long"
_NODES_COLUMNS = ("grp", "place", "digest", "n")


def _chunk_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """The next round's nodes."""

    def root(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("place"), int(rows["n"].iloc[0])
        top = _built(to_words(rows["digest"]), n, depth)
        digest = to_hex(top[-1].digests)[0] if top else rows["digest"].iloc[0]
        return pd.DataFrame({"grp": [key[0]], "place": [key[1]], "digest": [digest], "n": [-(-n // FAN**depth)]})

    return nodes.select(*_NODES_COLUMNS).groupBy("grp", _chunk(depth)).applyInPandas(root, _NODES)


def _chunk(depth: int) -> Column:
    return F.floor(F.col("place") / FAN**depth).cast("long").alias("chunk")


def _rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes of each round, up to that in which every group has one; only the largest number comes to the driver."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(saved(_chunk_roots(out[-1], depth)))
        most = -(-most // FAN**depth)
    return out


def _paths(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """``grp, place, path`` of the first of these rounds' nodes, from ``tops(grp, place, path)`` of the last one's."""

    def extend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        at = np.arange(len(rows))
        own = np.empty((len(rows), 0), np.uint8)
        for level in _built(to_words(rows["digest"]), int(rows["n"].iloc[0]), depth):
            own, at = np.concatenate([own, level.steps(at).packed()], axis=1), at // FAN
        rest = bytes(above["path"].iloc[0])
        return pd.DataFrame({"grp": rows["grp"], "place": rows["place"], "path": [x.tobytes() + rest for x in own]})

    for nodes in reversed(rounds):
        both = nodes.select(*_NODES_COLUMNS).groupBy("grp", _chunk(depth)).cogroup(tops.groupBy("grp", F.col("place").alias("chunk")))
        tops = saved(both.applyInPandas(extend, "grp string, place long, path binary"))
    return tops


def _folded(leaves: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Each leaf with its folded root and its proof's hash; ``claim`` is the hash that is folded."""

    def fold(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        at, value = np.arange(len(rows)), to_words(rows["claim"])
        proof, blocks = np.broadcast_to(START, (len(rows), 8)), np.zeros(len(rows), np.int64)
        steps = []
        for level in _built(to_words(rows["digest"]), int(rows["n"].iloc[0]), depth):
            steps.append(level.steps(at))
            at = at // FAN
        for step in [*steps, *Steps.unpacked(bytes(above["path"].iloc[0]), len(rows))]:
            value = step.fold(value)
            proof, blocks = step.add_siblings(proof, blocks)
        proof = compress(proof, _last_blocks(blocks))
        done = {"id": rows["id"], "grp": rows["grp"], "digest": rows["digest"], "folded_root": to_hex(value), "proof_sha256": to_hex(proof)}
        return pd.DataFrame(done)

    rows = leaves.select("id", *_NODES_COLUMNS, "claim").groupBy("grp", _chunk(depth))
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, grp string, digest string, folded_root string, proof_sha256 string"
    return rows.cogroup(above.groupBy("grp", F.col("place").alias("chunk"))).applyInPandas(fold, schema)


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 (hexadecimal) of values: each ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def manifest(
    df: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    *,
    replace: Callable[[str, Column], Column] = lambda name, value: value,
    depth: int = DEPTH,
) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves are rows' hashes (``leaf_of`` the columns). In each group they ascend by id
    (null first, then by leaf; rows alike in both are interchangeable), and every three
    nodes in a row become one, a last run of one or two too, until one remains: the
    subroot. Subroots in order of their groups (null first, UTF-8 bytewise) become the root
    likewise. ``proof_sha256`` hashes a leaf's siblings, level by level. ``replace`` gives
    what a column is claimed to be now; ``folded_root`` is the root that the claimed row
    has with the original siblings, by the parents' kept states, and ``verified`` tells
    whether it is the root. Null texts and other nulls are values of their own; a table
    with one row has its leaf as root; tasks get ``3 ** depth`` neighbours at most; an empty table gives no rows. Columns that are not
    named are not read. Ids and groups may be of any type that casts to text.
    """
    ship(df.sparkSession)
    with scratch(df.sparkSession) as keep:
        col = lambda c: F.col(f"`{c}`")
        grp = F.concat(F.lit("s"), col(group_col).cast("string"))
        claims = leaf_of([replace(c, col(c)) for c in columns]).alias("claim")
        rows = df.select(col(id_col).alias("id"), F.coalesce(grp, F.lit("")).alias("grp"), leaf_of([col(c) for c in columns]).alias("digest"), claims)
        leaves = saved(ranked(rows, "grp", ["id", "digest"]))
        rounds = _rounds(leaves, depth)
        subroots = rounds[-1].select(F.lit("").alias("all"), "grp", "digest")
        tops = saved(ranked(subroots, "all", ["grp"]))
        roots = _rounds(tops.select(F.col("all").alias("grp"), "place", "digest", "n"), depth)
        above = _paths(roots[:-1], roots[-1].select("grp", "place", F.lit(b"").alias("path")), depth)
        above = tops.join(above.select("place", "path"), "place").select("grp", F.lit(0).cast("long").alias("place"), "path")
        folded = _folded(leaves, _paths(rounds[1:-1], above, depth), depth)
        named = tops.select("grp", F.col("digest").alias("subroot"))
        root = roots[-1].select(F.col("digest").alias("root")).first()
        out = folded.join(named, "grp").withColumn("root", F.lit(root[0] if root else None).cast("string"))
        return keep(
            out.select(
                F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
                (F.col("folded_root") == F.col("root")).alias("verified"),
            )
        )
