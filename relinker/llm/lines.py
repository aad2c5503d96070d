"""Substring dedup by hashing lines and paragraphs, and passages inside them.

Units are normalised and hashed; the earliest occurrence of each digest over all
documents stays and the others are marked for removal, with their place in the
original text. Lines and paragraphs are taken whole, however short. A passage that is
put into the middle of other text is no line there, so windows of words are hashed
too: of each ``AMONG`` neighbouring windows the one with the least hash (winnowing),
which picks the same windows wherever the passage stands.

``repeated_units`` gives the units as they were hashed. ``repeated_runs`` goes on from
there: it follows a repeat to its ends, word by word, and leaves what is kept whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import documents, lots, saved, scratch

KINDS = ("line", "paragraph", "passage")
#: Words of a passage window, and windows of which one is taken: any repeat of WINDOW + AMONG - 1 words is met.
WINDOW, AMONG = 16, 24
#: Words compared on each side of a window: so many can lie between a repeat's end and its next window.
BESIDE = AMONG - 1
#: Bytes of a word's hash that are sent for that: a wrong word goes once in some 5 x 10^11 matches.
_SENT = 5
#: Bytes of the texts that are cut at once; a longer text is cut alone.
_LOT = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 17)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(m, b)))) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash of each range of ``values``, the same wherever the range stands."""
    up, down = _POWERS[which].of(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _least_windows(hashes: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Places of the last least hash of each ``AMONG`` windows in a row that lie in one text.

    ``fits``: whether the windows from here to the last of the row do so.
    """
    if len(hashes) < AMONG:
        return np.empty(0, np.int64)
    back = np.lib.stride_tricks.sliding_window_view(hashes, AMONG)[:, ::-1]
    whole = np.flatnonzero(fits[: len(back)])
    found = np.concatenate([i + AMONG - 1 - back[i].argmin(axis=1) for i in np.array_split(whole, len(whole) // 65536 + 1)])
    return found[np.diff(found, prepend=-1) > 0]  # they never go back


def units(texts: list[str], kinds: tuple[str, ...] = KINDS) -> dict[str, np.ndarray]:
    """Units of texts: ``doc`` (place in the list), ``kind`` (in KINDS), ``start``, ``end`` (code points), ``h1``, ``h2``.

    Normal form: the words between white space (bytes 0x20 and 0x09 to 0x0D), A-Z
    lower-cased. A line ends at a newline, a paragraph at lines without a word; a
    paragraph of one line is that line only. Units without a word are none.
    """
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    doc_starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1))
    begin, stop = edge[0::2], edge[1::2]
    if not len(begin):
        none = np.empty(0, np.int64)
        return {"doc": none, "kind": none, "start": none, "end": none, "h1": none, "h2": none}
    wide = b.astype(np.uint64) + np.uint64(1)
    words = [_range_hashes(wide, begin, stop, i) for i in range(2)]
    newline = np.flatnonzero(b == 10)
    line = np.searchsorted(newline, begin)
    doc = np.repeat(np.arange(len(data)), np.diff(np.searchsorted(begin, doc_starts)))
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # kind, first and last word, first and last byte
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.concatenate((first[1:], [len(line)]))
    line_start, line_end = np.concatenate(([0], newline + 1))[line[first]], newline[line[first]]
    if "line" in kinds:
        found.append((0, first, last, line_start, line_end))
    if "paragraph" in kinds:
        head = np.flatnonzero((np.diff(line[first], prepend=-2) > 1) | (np.diff(doc[first], prepend=-1) > 0))
        tail = np.concatenate((head[1:], [len(first)])) - 1
        head, tail = head[tail > head], tail[tail > head]
        found.append((1, first[head], last[tail], line_start[head], line_end[tail]))
    if "passage" in kinds and len(begin) >= WINDOW:
        at = np.arange(len(begin) - WINDOW + 1)
        end = np.minimum(at + WINDOW + AMONG - 2, len(doc) - 1)
        at = _least_windows(_range_hashes(words[0], at, at + WINDOW, 0), doc[at] == doc[end])
        found.append((2, at, at + WINDOW, begin[at], stop[at + WINDOW - 1]))
    kind = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
    a, z, start, end = (np.concatenate([f[i] for f in found]) for i in range(1, 5))
    points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    base = points[doc_starts[doc[a]]]
    salt = _mixed(kind.astype(np.uint64) + np.uint64(7))
    h1, h2 = ((_range_hashes(words[i], a, z, i) ^ salt).view(np.int64) for i in range(2))
    return {"doc": doc[a], "kind": kind, "start": points[start] - base, "end": points[end] - base, "h1": h1, "h2": h2}


def _units_of(docs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The units of ``docs(doc_id, text, tag)``."""

    def cut(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            ids, tags = batch["doc_id"].to_numpy(np.int64), batch["tag"].to_numpy(np.int64)
            for a, z in lots([len(t) for t in texts], _LOT):
                with np.errstate(over="ignore"):
                    u = units(texts[a:z], kinds)
                row = u.pop("doc") + a
                yield pd.DataFrame({"doc_id": ids[row], "tag": tags[row], **u})

    return docs.mapInPandas(cut, "doc_id long, tag long, kind byte, start int, end int, h1 long, h2 long")


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(df, id_col, text_col).filter("doc_id IS NOT NULL").withColumn("tag", F.xxhash64("text"))


def repeated_units(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """A row for each unit that repeats an earlier one: ``doc_id, tag, kind, start, end, kept_doc_id, kept_start``.

    Places are code points of the original text, end exclusive; ``kind`` is line,
    paragraph or passage (of ``WINDOW`` words) and ``tag`` a hash of the text, which
    tells texts under one id apart. Units rank by (doc_id, tag, start); the first of
    each digest is kept, within a document too. Any repeat of WINDOW + AMONG - 1 words
    is met by a passage; words at its ends, and some between passages, may stay. Hashes
    are counted over all documents, and digests grouped where the first 64 bits repeat,
    with partial sums before the shuffle: a digest that is everywhere is one row of the
    group, and its occurrences meet it in a join that Spark may split. Null and empty texts have no units. Rows with a null id have no
    rank and are left out; rows that repeat an id and text repeat its units at the
    same place, and count as one with it.
    """
    with scratch(df.sparkSession) as keep:
        found = _repeated(saved(_units_of(_tagged(df, id_col, text_col), kinds)))
        firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"), F.count("*").alias("n"))
        firsts = saved(firsts.filter("n > 1").select("h1", "h2", "first"))
        at_first = F.struct("doc_id", "tag", "start") == F.col("first")
        later = found.join(firsts, ["h1", "h2"]).filter(~at_first)
        name = F.array(*(F.lit(k) for k in KINDS))[F.col("kind")].alias("kind")
        kept = (F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
        return keep(later.select("doc_id", "tag", name, "start", "end", *kept))


def _repeated(found: DataFrame) -> DataFrame:
    """The rows of units whose ``h1`` another row has too: all that repeat, and next to none that occurs once.

    Over all units only hashes are counted (8 bytes each to shuffle); what is sorted and grouped after is the repeats alone.
    No side of the join is sorted: the hashed one has a row per ``h1`` that repeats, dealt out evenly.
    """
    often = saved(found.groupBy("h1").count().filter("count > 1").select("h1"))
    return saved(found.join(often.hint("shuffle_hash"), "h1", "left_semi"))


def _squeezed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, tag, size, text)``: A-Z lower-cased, as Zstandard's bytes, and how many there were; less to shuffle."""

    def squeeze(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = [t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array([len(t) for t in texts], pa.int32())]
            text = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, text], ["doc_id", "tag", "size", "text"])

    return docs.select("doc_id", "tag", "text").mapInArrow(squeeze, "doc_id long, tag long, size int, text binary")


class _Words:
    """The words of squeezed texts, as ``units`` takes words: starts, ends (code points) and hashes.

    ``first``: each text's first word, and the number of all.
    """

    def __init__(self, rows: pa.RecordBatch):
        codec = pa.Codec("zstd")
        sizes, texts = (rows.column(c).to_pylist() for c in ("size", "text"))
        b = np.frombuffer(b"\n".join([*(codec.decompress(t, n, asbytes=True) if n else b"" for t, n in zip(texts, sizes)), b""]), np.uint8)
        heads = np.cumsum([0, *(n + 1 for n in sizes)])
        edge = np.flatnonzero(np.diff(((b == 32) | ((b >= 9) & (b <= 13))).astype(np.int8), prepend=1))
        begin, stop = edge[0::2], edge[1::2]
        self.first = np.searchsorted(begin, heads)
        points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
        text = np.repeat(np.arange(len(sizes)), np.diff(self.first))
        base = points[heads[text]]
        self.begin, self.stop = points[begin] - base, points[stop] - base
        self.place = (text << 32) + self.begin
        with np.errstate(over="ignore"):
            self.hashes = _range_hashes(b.astype(np.uint64) + np.uint64(1), begin, stop, 0)

    def at(self, text: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The first word of each text that starts at a code point or after it; the next text's first, if none does."""
        return np.searchsorted(self.place, (text << 32) + point)


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each value in a column of arrays (null: none), and the values."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten()


def _sent(words: _Words, at: np.ndarray, within: np.ndarray) -> pa.Array:
    """The low ``_SENT`` bytes of the hashes of those words in each row of ``at`` that are ``within``, in a row."""
    ends = np.concatenate(([0], np.cumsum(within.sum(axis=1) * _SENT))).astype(np.int32)
    sent = words.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[at[within], :_SENT]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(sent.tobytes())])


def _alike(words: np.ndarray, at: np.ndarray, step: int, beside: pa.Array, which: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words in a row, from each place on in steps of 1 or -1 and from ``least`` to before ``most``, are those of ``beside[which]``."""
    size = pc.binary_length(beside).fill_null(0).to_numpy() // _SENT
    far, out = np.arange(BESIDE), [np.empty(0, np.int64)]
    hashes = np.zeros((len(size), BESIDE, 8), np.uint8)
    sent = np.frombuffer(b"".join(x for x in beside.to_pylist() if x), np.uint8)
    hashes[:, :, :_SENT][far < size[:, None]] = sent.reshape(-1, _SENT)
    hashes = hashes.view("<u8")[:, :, 0]
    words = words & np.uint64((1 << 8 * _SENT) - 1)
    for some in np.array_split(np.arange(len(at)), len(at) // 65536 + 1):
        i, w = at[some, None] + step * far, which[some]
        same = (i >= least[some, None]) & (i < most[some, None]) & (far < size[w, None])
        same &= words[np.where(same, i, 0)] == hashes[w]
        out.append(np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64))
    return np.concatenate(out)


def _in_lots(batches):
    """Rows of squeezed texts that are worked on at once."""
    for batch in batches:
        for a, z in lots(batch.column("size").to_pylist(), _LOT):
            yield batch.slice(a, z - a)


def _beside(batches):
    """For each kept window of each text, the hashes of the words before (nearest first) and after it."""
    far = np.arange(BESIDE)
    for rows in _in_lots(batches):
        words = _Words(rows)
        text, starts = _flat(rows.column("starts"))
        at = words.at(text, starts.to_numpy())
        h1, h2 = (rows.column(c).flatten() for c in ("h1", "h2"))
        for a in range(0, len(at), 65536):
            i, t = at[a : a + 65536, None], text[a : a + 65536]
            back, on = i - 1 - far, i + WINDOW + far
            before = _sent(words, back, back >= words.first[t][:, None])
            after = _sent(words, on, on < words.first[t + 1][:, None])
            yield pa.RecordBatch.from_arrays([h1.slice(a, 65536), h2.slice(a, 65536), before, after], ["h1", "h2", "before", "after"])


def _runs(batches):
    """The maximal runs of words that each text loses."""
    for rows in _in_lots(batches):
        words = _Words(rows)
        of_digest, kind = _flat(rows.column("kind"))
        which, starts = _flat(rows.column("starts").flatten())
        ends = rows.column("ends").flatten().flatten()
        text = of_digest[which]
        a, z = (words.at(text, side.to_numpy()) for side in (starts, ends))
        some = np.flatnonzero(kind.to_numpy()[which] == KINDS.index("passage"))
        if len(some):
            digest, t = which[some], text[some]
            own = rows.column("own_end").flatten().to_numpy()[digest]
            least, most = words.first[t], words.first[t + 1]
            before, after = (rows.column(c).flatten() for c in ("before", "after"))
            left = _alike(words.hashes, a[some] - 1, -1, before, digest, np.where(own < 0, least, words.at(t, own)), most)
            right = _alike(words.hashes, z[some], 1, after, digest, least, most)
            a[some] -= left
            z[some] += right
        # a text's words have a slot each, and one more that nothing takes: so no run goes on in the next text
        n = len(words.begin) + len(rows) + 1
        covered = lambda a, z: np.cumsum(np.bincount(a, minlength=n) - np.bincount(z, minlength=n)) > 0
        gone = covered(a + text, z + text)
        kept, kept_starts = _flat(rows.column("kept_starts"))
        ka, kz = (words.at(kept, side.to_numpy()) + kept for side in (kept_starts, rows.column("kept_ends").flatten()))
        many = np.concatenate(([0], np.cumsum(gone)))
        whole = many[kz] - many[ka] < kz - ka  # repeats do not cover all of it
        gone &= ~covered(ka[whole], kz[whole])
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        first, end = edge[0::2], edge[1::2]
        t = np.repeat(np.arange(len(rows)), np.diff(words.first) + 1)[first]
        place = (words.begin[first - t], words.stop[end - 1 - t], end - first)
        columns = [rows.column(c).take(pa.array(t)) for c in ("doc_id", "tag")] + [pa.array(x, pa.int32()) for x in place]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "end", "n_words"])


def repeated_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """A row for each maximal run of words that an earlier place has too: ``doc_id, tag, start, end, n_words``.

    The units of ``repeated_units``, and besides:

    - A passage that repeats is followed to both sides, by up to ``BESIDE`` words, as
      long as the words are those beside the kept occurrence (within one text, not back
      into that occurrence). Where the kept occurrence lies in the same repeat, all
      words of a repeat of WINDOW + AMONG - 1 or more go. Words are compared by 40-bit
      hashes.
    - A kept occurrence stays whole, even where other repeats overlap it, unless
      repeats cover all of its words, which earlier places then have. Any word that
      goes has an equal one at an earlier place (doc_id, tag, start), and those in turn
      until one that stays.

    Places are code points, from a run's first word to the end of its last; white space
    around a run stays. Nulls, empty texts, null ids and repeated rows are as in
    ``repeated_units``. Only texts with repeats are read again, each joined to its own
    places: of a digest, a text gets its places and one pair of neighbourhoods
    (2 x ``BESIDE`` hashes), however often it holds it, so a row follows the text's length.
    """
    with scratch(df.sparkSession) as keep:
        docs = _tagged(df, id_col, text_col)
        found = _repeated(saved(_units_of(docs, kinds)))
        place = F.struct("doc_id", "tag", "start", "end")
        ends = (F.min(place).alias("first"), F.max(place).alias("last"), F.min("kind").alias("kind"))
        firsts = saved(found.groupBy("h1", "h2").agg(*ends).filter("first <> last").select("h1", "h2", "kind", "first.*"))
        passages = firsts.filter(F.col("kind") == KINDS.index("passage")).groupBy("doc_id", "tag")
        passages = passages.agg(F.collect_list(F.struct("start", "h1", "h2")).alias("w"))
        docs = _squeezed(docs)
        passages = docs.join(passages, ["doc_id", "tag"]).select("size", "text", F.col("w.start").alias("starts"), "w.h1", "w.h2")
        beside = passages.mapInArrow(_beside, "h1 long, h2 long, before binary, after binary").dropDuplicates(["h1", "h2"])
        known = firsts.select("h1", "h2", place.alias("first")).join(beside, ["h1", "h2"], "left")
        # a text's places of a digest are one row before they meet the neighbourhoods, and the join sorts neither side
        places = found.repartition("h1", "h2").groupBy("h1", "h2", "doc_id", "tag")
        places = places.agg(F.min("kind").alias("kind"), F.collect_set(F.struct("start", "end")).alias("p"))
        own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
        later = places.join(known.hint("shuffle_hash"), ["h1", "h2"]).withColumn("own_end", F.when(own, F.col("first.end")).otherwise(-1))
        others = F.array_remove("p", F.struct("first.start", "first.end"))
        digests = later.withColumn("p", F.when(own, others).otherwise(F.col("p"))).filter(F.size("p") > 0)
        each = F.struct("kind", F.col("p.start").alias("starts"), F.col("p.end").alias("ends"), "own_end", "before", "after")
        digests = digests.groupBy("doc_id", "tag").agg(F.collect_list(each).alias("d"))
        kept = firsts.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("k"))
        both = docs.join(digests.join(kept, ["doc_id", "tag"], "left"), ["doc_id", "tag"])
        fields = (f"d.{c}" for c in ("kind", "starts", "ends", "own_end", "before", "after"))
        both = both.select("doc_id", "tag", "size", "text", *fields, F.col("k.start").alias("kept_starts"), F.col("k.end").alias("kept_ends"))
        runs = both.mapInArrow(_runs, "doc_id long, tag long, start int, end int, n_words int")
        return keep(runs.dropDuplicates(["doc_id", "tag", "start"]))


def remove_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``df``, all its columns, with the repeated units cut out of ``text_col``.

    Each text is cut by its own spans, also where an id has several; spans may
    overlap. A null text or id stays as it is.
    """
    return _without(df, repeated_units(df, id_col, text_col, **kw), id_col, text_col)


def remove_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``df``, all its columns, without the runs of ``repeated_runs``; else as ``remove_units``."""
    return _without(df, repeated_runs(df, id_col, text_col, **kw), id_col, text_col)


def _without(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans")
    )
    text = F.col(text_col)
    both = df.join(spans, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__tag")), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))).alias("out"),
    )
    left = F.aggregate("__spans", zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return both.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(left)).select(*df.columns)
