"""Best-fit packing of token sequences into bins of fixed capacity.

The plan is made on the histogram of lengths (``capacity`` rows at most, whatever
the corpus): pieces above a third of the capacity pair at most twice per bin, the
largest with the largest that fits; the others, by falling length, go to the
tightest gap. Spark then ranks the pieces within each length, in salted groups,
and each piece finds its bin and place from its length and rank alone.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relinker.llm.common import arrow_batches, documents, lots, parts, saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: A text with one of these goes to the tokenizer whole: white space only to Python, zero (fills keys), special
#: tokens, and letters whose lower case depends on their neighbours.
_ODD = ("\0", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
_ODD_LETTERS = ("Σ", "İ", "\u0345")
#: White space beyond ASCII, as Python splits by it.
_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words and parts of words that a worker holds; bytes of a word that is looked up there.
_CACHE, _UNITS, _KEY = 400_000, 50_000, 16
#: Bytes of the texts that are strings at once and split at once (their words are ten times as large); a longer text is alone.
_LOT = 1 << 20
#: Signs that the tokenizer's split always sets apart from the letters before them.
_STOPS = frozenset(".,;:!?")


class WordTokens:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are
    its words' ids one after the other; words met before come from a bounded table,
    of which what was met again since its last turn outlives the next.
    """

    _open: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        #: Fixed value: the tokenizer's own split into what it encodes on its own.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.units: dict[str, bytes] = {}
        #: The words met, by hash (the last is none): two halves of the key, place and number of ids in the pool, whether met again since the last turn.
        self.hash, self.low, self.high = np.array([2**64 - 1], np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.at, self.many, self.met = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
        self.pool = np.empty(0, "<u4")

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One for each Python worker and path."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, units: list[str]) -> None:
        for i in range(0, len(units), 512):
            some = units[i : i + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):
                self.units.update((u, self._whole(u)) for u in some)
                continue
            data, at = ids.tobytes(), 0
            for unit, cut in zip(some, cuts.tolist()):
                self.units[unit] = data[at:cut]
                at = cut

    def _units(self, word: str) -> Sequence[str]:
        """The parts of a word that are encoded on their own; most words need no pattern."""
        if word.isalpha():
            return (word,)
        if word[-1] in _STOPS and word[:-1].isalpha():
            return word[:-1], word[-1]
        return self.split(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import unicodedata

        def strange(t: str) -> bool:
            """Whether a character is newer than the tables that the tokenizer may have."""
            return any(unicodedata.category(c) == "Cn" for c in set(t) if c > "\x7f")

        plain = [
            not any(c in t for c in _ODD)
            and (t.isascii() or unicodedata.is_normalized("NFC", t) and not any(c in t for c in _ODD_LETTERS) and not strange(t))
            for t in texts
        ]
        data = [_WHITE.sub(" ", t.lower()).encode("utf-8", "surrogatepass") if p else b"" for p, t in zip(plain, texts)]
        ids, bounds = self._encode_words(data)
        return [ids[a:z].tobytes() if p else self._whole(t) for p, t, a, z in zip(plain, texts, bounds, bounds[1:])]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by its parts."""
        cut = [self._units(w) for w in words]
        if len(self.units) > _UNITS:
            self.units = {}
        self._learn([u for u in set().union(*cut) if u not in self.units])
        unit = self.units.__getitem__
        return [unit(u[0]) if len(u) == 1 else b"".join(map(unit, u)) for u in cut]

    def _turn(self) -> None:
        """Keep the words met again since the last turn, or none if they are too many."""
        keep = np.flatnonzero(self.met) if self.met.sum() <= _CACHE // 2 else np.zeros(1, np.int64)
        keep = np.union1d(keep, [len(self.hash) - 1])
        self.pool, ends = _gathered(self.pool, self.at[keep], self.many[keep])
        self.hash, self.low, self.high, self.many = (x[keep] for x in (self.hash, self.low, self.high, self.many))
        self.at, self.met = ends[:-1], np.zeros(len(keep), bool)

    def _more(self, pool: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool with the words' ids behind its own, and their places and numbers there."""
        found = self._ids(words)
        many = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        at = len(pool) + np.cumsum(many) - many
        return np.concatenate((pool, np.frombuffer(b"".join(found), "<u4"))), at, many

    def _encode_words(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all of ``data``, and where those of each begin and end.

        A word of up to ``_KEY`` bytes is its own key, as two 64-bit numbers, so words are looked up
        for a lot at once; their hash only orders the table, and keys are compared.
        """
        if len(self.hash) > _CACHE:
            self._turn()
        line = b"\n".join([*data, bytes(_KEY)])
        b = np.frombuffer(line, np.uint8)
        white = (b == 32) | ((b >= 9) & (b <= 13))
        white[-_KEY:] = True
        edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=np.int8(1)))
        begin, stop = edge[0::2], edge[1::2]
        starts = np.cumsum([0, *(len(d) + 1 for d in data)])
        size = stop - begin
        key = np.lib.stride_tricks.sliding_window_view(b, _KEY)[begin]
        key[np.arange(_KEY) >= size[:, None]] = 0
        low, high = key.view("<u8").T
        with np.errstate(over="ignore"):
            hashes = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        word = lambda i: line[begin[i] : stop[i]].decode("utf-8", "surrogatepass")
        each, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        here = np.minimum(np.searchsorted(self.hash, each), len(self.hash) - 1)
        hit = (self.hash[here] == each) & (self.low[here] == low[first]) & (self.high[here] == high[first])
        fits = size[first] <= _KEY
        new = np.flatnonzero(~hit & fits)
        at, many = self.at[here], self.many[here]
        self.met[here[hit]] = True
        self.pool, at[new], many[new] = self._more(self.pool, [word(i) for i in first[new].tolist()])
        # longer words, and those whose hash another has, go by themselves: no key finds them again, so the pool doesn't keep them
        alone = np.flatnonzero((size > _KEY) | (low != low[first[which]]) | (high != high[first[which]]) | ~fits[which])
        pool, at, many = self.pool, at[which], many[which]
        if len(alone):
            pool, at[alone], many[alone] = self._more(pool, [word(i) for i in alone.tolist()])
        ids, ends = _gathered(pool, at, many)
        new = new[self.hash[here[new]] != each[new]]
        place, source = np.searchsorted(self.hash, each[new]), first[new]
        for name, values in (("hash", each[new]), ("low", low[source]), ("high", high[source]), ("at", at[source]), ("many", many[source]), ("met", False)):
            setattr(self, name, np.insert(getattr(self, name), place, values))
        return ids, ends[np.searchsorted(begin, starts)]


def _gathered(pool: np.ndarray, at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool, one after the other, and where each begins, with the end."""
    ends = np.concatenate(([0], np.cumsum(many)))
    return pool[np.arange(ends[-1]) + np.repeat(at - ends[:-1], many)], ends


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """A row for each piece of each row of ``docs(doc_id, text)``: its ids, then id 0, cut at ``capacity``."""

    def cut(batches):
        tokens = WordTokens.of(tokenizer)
        for batch in batches:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()  # what batches and stages before this one left with the allocators
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for lo, hi in lots(sizes, _LOT):
                some, out = batch.slice(lo, hi - lo), []
                for doc, ids in zip(some.column("doc_id").to_pylist(), tokens.encode(some.column("text").to_pylist())):
                    ids += b"\0\0\0\0"
                    doc = None if pd.isna(doc) else int(doc)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return docs.mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, from how many of each length there are.

    Returns rows ``length, first rank, pieces a bin, first bin, offset, ranks`` (the
    ranks from the first on fill bins one after the other, so many a bin) in the
    order of length and first rank, and the number of bins.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rows: list[tuple[int, ...]] = []
    ranks: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bins = 0

    def place(n: int, each: int, first: int, used: int, total: int) -> None:
        rows.append((n, ranks[n], each, first, used, total))
        ranks[n] += total

    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                take = left[n]
                place(n, 1, bins, 0, take)
                gaps[capacity - n].append((bins, take))
            elif mate == n:
                take = left[n] // 2
                place(n, 2, bins, 0, 2 * take)
                gaps[capacity - 2 * n].append((bins, take))
                left[n] -= take
            else:
                take = min(left[n], left[mate])
                place(n, 1, bins, 0, take)
                place(mate, 1, bins, n, take)
                gaps[capacity - n - mate].append((bins, take))
                left[mate] -= take
            left[n] -= take
            bins += take

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        heap = sorted(g for g in gaps if g >= n and gaps[g])
        while left[n]:
            if not heap:
                take = -(-left[n] // (capacity // n))
                gaps[capacity].append((bins, take))
                bins += take
                heappush(heap, capacity)
            gap = heap[0]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                heappop(heap)
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                place(n, each, first, capacity - gap, full * each)
                gaps[gap - each * n].append((first, full))
                left[n] -= full * each
            first, many = first + full, many - full
            if many and left[n]:  # fewer are left than one bin takes
                place(n, left[n], first, capacity - gap, left[n])
                gaps[gap - left[n] * n].append((first, 1))
                left[n] = 0
                first, many = first + 1, many - 1
            if many:
                gaps[gap].append((first, many))
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return table, bins


def best_fit_pack(pieces: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces(doc_id, piece, ..., length)``.

    Every row with a length from 1 to ``capacity`` gets a place; offsets in a
    sequence are gapless from 0. Ties (equal lengths, repeated or null ids) are
    dealt by salt and id, and are interchangeable. An empty input gives no rows.
    The pieces are saved once, with their salts, so a retried task sees the same ranks
    and no id or length has more than its share of a task.
    """
    spark = pieces.sparkSession
    salts = salts or max(8, parts(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    with arrow_batches(spark):
        salted = saved(salted)
    groups = saved(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    #: One row for each length from 1 to capacity: bounded, whatever the corpus.
    histogram = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rows, _ = plan_bins(histogram, capacity)
    keys = rows[:, 0] * 2**44 + rows[:, 1]
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    base = groups.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(base.hint("merge"), ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        hit = rows[np.searchsorted(keys, n * 2**44 + r, side="right") - 1]
        at = r - hit[:, 1]
        return pd.DataFrame({"sequence_id": hit[:, 3] + at // hit[:, 2], "offset": hit[:, 4] + at % hit[:, 2] * n})

    placed = ranked.withColumn("_at", place(F.col("length"), F.col("_base") + F.col("_row") - 1))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(
    df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document of ``df`` into sequences of at most ``capacity`` tokens.

    A document is its text's ids and then id 0, so a null or empty text is one
    token. Only longer ones are cut. Columns beside id and text are not carried;
    rows that repeat are packed each for itself; an empty table gives no rows.
    """
    return best_fit_pack(token_pieces(documents(df, id_col, text_col), tokenizer, capacity), capacity)
