"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has one
piece that occurs unchanged. Piece hits come from an Aho-Corasick automaton; each is
verified by Myers' bit-parallel edit distance on the text around it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import saved, ship

#: ASCII letters lower-cased, other ASCII characters but digits to spaces; bytes from 128 stay.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str) -> str:
    """Lower-cased words and numbers, joined by single spaces."""
    kept = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    return b" ".join(kept.split()).decode("utf-8", "surrogatepass")


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j)
    return best


class Matcher:
    """The pieces of a block of items as one automaton."""

    _open: dict[str, Matcher] = {}

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            cuts = [len(text) * k // (errors + 1) for k in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((n, b))
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, items: list[tuple[int, str]], error_rate: float) -> Matcher:
        """One for each Python worker and block."""
        if name not in cls._open:
            if len(cls._open) > 4:
                cls._open.clear()
            cls._open[name] = cls(items, error_rate)
        return cls._open[name]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """``item_id, distance, end`` of each item within its budget: its best place in the normal text."""
        if not len(self.automaton):
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - at)
        found = []
        for n, diagonals in starts.items():
            item, pattern, errors = self.items[n]
            best, done = (errors + 1, 0), -1
            for d in sorted(diagonals):  # neighbouring diagonals share a window
                if d <= done:
                    continue
                low = max(0, d - errors)
                done = d + errors
                got, end = best_match(pattern, text[low : done + len(pattern) + errors])
                if got < best[0]:
                    best = (got, low + end)
            if best[0] <= errors:
                found.append((item, *best))
        return found


Block = tuple[str, list[tuple[int, str]]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """How many blocks of about ``block_bytes`` the items make, and the blocks, each fetched when it is asked for.

    So what the driver holds and one pass ships is bounded, however many there are.
    Null ids and items without a letter or digit cannot be matched and are in no block.
    """
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes

    def each() -> Iterator[Block]:
        for b in range(blocks):
            rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
            yield uuid.uuid4().hex, [(r.id, t) for r in rows if (t := normal(r.text))]

    return blocks, each()


def contamination(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, block_bytes: int = 4_000_000,
) -> DataFrame:
    """``doc_id, item_id, distance, end`` for each row of ``df`` and each item that it holds.

    An item of n normal characters may differ by ``int(n * error_rate)`` edits, so one of
    less than 1 / ``error_rate`` (13) matches exactly, wherever its characters are in a row,
    within a word too: short items are to be left out before if that is not meant. ``end``
    is the place after its best match in the normal text. All items go against all
    rows, block by block; with several blocks, each one's rows are saved before the
    next block is fetched. Null and empty texts hold nothing; a null id stays null;
    repeated rows and items each count; items without a letter or digit match nothing.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    out = None
    blocks, each = item_blocks(items, item_id, item_text, block_bytes)
    for name, block in each:

        def search(batches, name=name, block=block):
            matcher = Matcher.of(name, block, error_rate)
            for batch in batches:
                rows = [
                    (None if pd.isna(d) else int(d), *hit)
                    for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist())
                    for hit in matcher.matches(t)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end"]).astype({"doc_id": "Int64"})

        found = docs.mapInPandas(search, "doc_id long, item_id long, distance int, end long")
        found = saved(found) if blocks > 1 else found
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(
    df: DataFrame, items: DataFrame, text_col: str = "text", *,
    item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.08, block_bytes: int = 4_000_000,
) -> DataFrame:
    """``df`` without the rows whose text holds an item; all columns stay, and rows with a null text.

    One block of items filters the rows where they lie; several are met one after the
    other, and what was found in the texts leaves by the texts' SHA-256.
    """
    ship(df.sparkSession)
    blocks, each = item_blocks(items, item_id, item_text, block_bytes)
    if blocks == 1:
        return df.filter(_clean(*next(each), error_rate)(F.col(text_col)))
    name = F.sha2(F.col(text_col).cast("binary"), 256)
    gone = None
    for block in each:
        held = df.filter(~_clean(*block, error_rate)(F.col(text_col))).select(name.alias("__gone")).distinct()
        gone = saved(held if gone is None else gone.union(held).distinct())
    return df.join(gone, name == F.col("__gone"), "left_anti")


def _clean(name: str, block: list[tuple[int, str]], error_rate: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        matcher = Matcher.of(name, block, error_rate)
        return pd.Series([t is None or not matcher.matches(t) for t in texts], dtype=bool)

    return clean
