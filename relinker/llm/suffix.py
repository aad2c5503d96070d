"""Exact substring dedup with suffix arrays.

Every string of ``length`` bytes has an anchor: the least hash among its 20-byte
parts. Equal strings have equal anchors, so an anchor in one document only cannot be
part of a repeat, and strings that share an anchor can be dealt to one place. The job:

0. whole texts that a smaller document has too go without a search;
1. each document's runs of windows with one anchor are listed, and anchors met in at
   least two documents are kept (their hashes, not the text, are shuffled);
2. the text under those runs goes to its anchor's bucket, where shards of it get
   suffix arrays (Larsson-Sadakane refinement) and common prefixes (Kasai), which give
   each distinct string the smallest document that has it; shards of one bucket are
   merged by binary search in their sorted strings;
3. each document takes back the byte ranges that a smaller document has too.

Anchors in very many runs leave step 2: tasks add them up before anything is shuffled,
so no bucket gets all their runs; their strings are summed up by a plain grouping with
partial sums, and each occurrence meets its string's row in a join that Spark may split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinker.llm.common import parts, remove, saved, scratch, shared_dir, ship

_ODD = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of an anchor: shorter ones meet by chance, longer ones are more.
PART = 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in order: Larsson-Sadakane, each round over unsorted groups only."""
    n = len(text)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text
    key[:n] += np.uint64(1)  # an end sorts before every byte; 7 bytes of 9 bits fill a word
    for shift, step in ((9, 1), (18, 2)):
        key[:-step] = key[:-step] << np.uint64(shift) | key[step:]
    wide = key.copy()
    wide[:-4] = key[:-4] << np.uint64(27) | key[4:] >> np.uint64(9)
    key, h = wide[:n], 7
    order = np.argsort(key)
    ranked = key[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    open_ = np.flatnonzero(~(first & np.concatenate((first[1:], [True])))) if n else np.empty(0, np.int64)
    while len(open_):
        at = order[open_]
        ahead = at + h
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[at] << 32 | following
        turn = np.argsort(pair)
        pair, at = pair[turn], at[turn]
        order[open_] = at
        first = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        open_ = open_[~(first & np.concatenate((first[1:], [True])))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order (0 for the first), at most ``most``.

    Kasai's lemma, all positions at once: where the bytes before a suffix and before
    its predecessor are equal, its value is that of the suffix one byte earlier less
    one. The other values are found by comparing.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]], before[order[1:]] = -1, order[:-1]
    at = np.arange(n)
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:], 1) - 1]) & (before[:-1] >= 0)
    own = np.flatnonzero(~carried & (before >= 0))
    value = np.zeros(n, np.int64)
    left, right, todo = own, before[own], own
    step = 0
    while len(todo):
        inside = (left + step < n) & (right + step < n)
        todo, left, right = todo[inside], left[inside], right[inside]
        same = text[left + step] == text[right + step]
        todo, left, right = todo[same], left[same], right[same]
        step += 1
        value[todo] = step
    source = np.maximum.accumulate(np.where(carried, 0, at))
    value = np.maximum(0, value[source] - (at - source))
    return np.minimum(value, most)[order]


def _merge(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings with their least document, of shards that are each sorted: by binary search."""
    keys, least = shards[0]
    for more, docs in shards[1:]:
        spot = np.searchsorted(keys, more)
        met = (spot < len(keys)) & (keys[np.minimum(spot, len(keys) - 1)] == more)
        least[spot[met]] = np.minimum(least[spot[met]], docs[met])
        keys, least = np.insert(keys, spot[~met], more[~met]), np.insert(least, spot[~met], docs[~met])
    return keys, least


def least_documents(pieces: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int, shard: int) -> np.ndarray:
    """For each window of each piece (bytes one after the other), the least document that has its string.

    Pieces lie in ``pieces`` by ``sizes``, each at least ``length``; windows are
    returned piece by piece. Shards hold whole pieces, about ``shard`` bytes each.
    """
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        base = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, base + shard, side="right"))))
    made = []
    for a, b in zip(cuts, cuts[1:]):
        text = pieces[ends[a - 1] if a else 0 : ends[b - 1]]
        size = sizes[a:b]
        start = np.cumsum(size) - size
        windows = np.arange(int((size - length + 1).sum())) + np.repeat(start - (np.cumsum(size - length + 1) - (size - length + 1)), size - length + 1)
        owner = np.zeros(len(text), np.int64)
        owner[windows] = np.repeat(docs[a:b], size - length + 1)
        is_window = np.zeros(len(text), bool)
        is_window[windows] = True
        order = suffix_array(text)
        group = np.cumsum(common_prefixes(text, order, length) < length)
        kept = is_window[order]
        place, group = order[kept], group[kept]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(owner[place], first)
        number = np.empty(len(text), np.int64)
        number[place] = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(place)]))))
        made.append((text, place[first], least, number[windows]))
    if len(made) == 1:
        return made[0][2][made[0][3]]
    strings = [
        np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[place]).view(f"S{length}").ravel()
        for text, place, _, _ in made
    ]
    keys, least = _merge([(s, m[2].copy()) for s, m in zip(strings, made)])
    return np.concatenate([least[np.searchsorted(keys, s)][m[3]] for s, m in zip(strings, made)])


def anchor_runs(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window (in the buffer), number of windows, anchor.

    Documents lie in the buffer at ``starts``; no window crosses a document's end.
    """
    n = len(buffer) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    part = max(1, min(PART, length // 2))
    with np.errstate(over="ignore"):
        bits = [(buffer.astype(np.uint64) + np.uint64(1)) * _ODD]
        factor = _ODD
        while 2 ** len(bits) <= part:
            x, w = bits[-1], 2 ** (len(bits) - 1)
            bits.append(x[:-w] * factor + x[w:])
            factor = factor * factor * np.uint64(3) + np.uint64(2)
        h, have = None, 0
        for k in reversed(range(len(bits))):
            if part >> k & 1:
                x = bits[k][have:]
                h = x if h is None else h[: len(x)] * np.uint64(0x94D049BB133111EB) + x
                have += 2**k
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    width, done = length - part + 1, 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    if width > done:
        h = np.minimum(h[: done - width], h[width - done :])
    inside = np.zeros(n + 1, np.int8)
    fit = sizes >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, starts[fit] + sizes[fit] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    edge = np.flatnonzero((h[1:] != h[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate(([0], edge))
    many = np.diff(np.concatenate((first, [n])))
    real = inside[first]
    return first[real], many[real], h[first[real]]


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return _squeeze(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.int64).ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids, nearly in order: their differences, packed."""
    return _pack(np.diff(ids, prepend=np.int64(0)))


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _joined(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in lots of about ``most`` bytes, with their UTF-8 bytes in one buffer, starts and sizes."""
    for batch in batches:
        data = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        a, held = 0, 0
        for b in range(len(data) + 1):
            if b == len(data) or (held and held + len(data[b]) > most):
                if b > a:
                    sizes = np.array([len(x) for x in data[a:b]], np.int64)
                    yield batch.iloc[a:b], np.frombuffer(b"".join(data[a:b]), np.uint8), np.cumsum(sizes) - sizes, sizes
                a, held = b, 0
            if b < len(data):
                held += len(data[b])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(ranked[a]), order[a:b]


_LOT = 1 << 20


def _summed(doc: np.ndarray, run: np.ndarray, anchor: np.ndarray, often: int) -> tuple[np.ndarray, ...]:
    """Partial sums of a lot: ``doc, run, anchor`` of the rarer anchors' runs, and ``doc, run`` of the others'.

    An anchor in over ``often`` runs of the lot, and two documents, is met by others for
    certain: its runs need not go to its bucket, where only the least and greatest of
    its documents stand for them (run -1).
    """
    order = np.argsort(anchor, kind="stable")
    ranked = anchor[order]
    cut = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    many = np.diff(np.concatenate((cut, [len(ranked)])))
    low, high = np.minimum.reduceat(doc[order], cut), np.maximum.reduceat(doc[order], cut)
    full = (many > often) & (low < high)
    gone = np.zeros(len(doc), bool)
    gone[order] = np.repeat(full, many)
    ends = np.concatenate((low[full], high[full]))
    return (
        np.concatenate((doc[~gone], ends)), np.concatenate((run[~gone], np.full(len(ends), -1))),
        np.concatenate((anchor[~gone], np.tile(ranked[cut][full], 2))), doc[gone], run[gone],
    )


def _list_anchors(length: int, buckets: int, often: int, lot: int = 24 << 20):
    """Per bucket of anchors: documents, run numbers and 32 more bits of the anchors, in compressed planes.

    What ``_summed`` keeps out of the buckets has a bucket under zero and no anchors.
    """

    def emit(found):
        doc, run, anchor, sure_doc, sure_run = _summed(*(np.concatenate(x) for x in zip(*found)), often)
        rows = [
            (b, _pack_ids(doc[i]), _pack(run[i]), (anchor[i] >> np.uint64(32)).astype(np.uint32).tobytes())
            for b, i in _by_bucket((anchor % np.uint64(buckets)).astype(np.int32))
        ]
        if len(sure_doc):
            rows.append((-1 - int(sure_doc[0] % buckets), _pack_ids(sure_doc), _pack(sure_run), b""))
        return pd.DataFrame(rows, columns=["bucket", "docs", "runs", "anchors"])

    def run(batches):
        found, held = [], 0
        for rows, buffer, starts, sizes in _joined(batches, _LOT):
            ids = rows["doc_id"].to_numpy(np.int64)
            first, _, anchor = anchor_runs(buffer, starts, sizes, length)
            if not len(first):
                continue
            row = np.searchsorted(starts, first, side="right") - 1
            number = np.arange(len(first)) - np.searchsorted(row, np.arange(len(ids)))[row]
            found.append((ids[row], number, anchor))
            held += len(buffer)
            if held > lot:
                yield emit(found)
                found, held = [], 0
        if found:
            yield emit(found)

    return run


def _shared_runs(hot: int):
    """Rows ``doc_id, run`` of the anchors met in two documents at least; -1 - run where they are hot.

    Hot: in more than ``hot`` runs of a bucket, or in too many of a lot.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([_unpack_ids(x) for x in group["docs"]])
        run = np.concatenate([_unpack(x) for x in group["runs"]])
        if group["bucket"].iloc[0] < 0:
            run = -1 - run
        else:
            anchor = np.frombuffer(b"".join(group["anchors"]), np.uint32)
            order = np.argsort(anchor)
            ranked, doc, run = anchor[order], doc[order], run[order]
            cut = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            many = np.diff(np.concatenate((cut, [len(ranked)])))
            low, high = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
            full = (many > hot) | (np.minimum.reduceat(run, cut) < 0)
            kept = np.repeat(low < high, many) & (run >= 0)
            run = np.where(np.repeat(full, many), -1 - run, run)
            doc, run = doc[kept], run[kept]
        turn = np.lexsort((run, doc))
        return pd.DataFrame({"doc_id": doc[turn], "run": run[turn].astype(np.int32)})

    return pick


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _wanted(batches, length: int, hot: bool):
    """For each lot: its buffer and, of its listed runs, row, document, tag, first window, windows, anchor."""
    for rows, buffer, starts, sizes in _joined(batches, _LOT):
        first, many, anchor = anchor_runs(buffer, starts, sizes, length)
        row = np.searchsorted(starts, first, side="right") - 1
        base = np.searchsorted(row, np.arange(len(rows)))
        lists = [np.asarray(x, np.int64) for x in rows["runs"]]
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        listed = np.concatenate(lists) if lists else np.empty(0, np.int64)
        keep = (listed < 0) == hot
        number, owner = np.where(listed < 0, -1 - listed, listed)[keep], owner[keep]
        runs_of = np.diff(np.concatenate((base, [len(row)])))
        real = number < runs_of[owner]  # another text under the same id may have more runs
        i = np.unique(base[owner[real]] + number[real])
        ids = rows["doc_id"].to_numpy(np.int64)[row[i]]
        tags = rows["tag"].to_numpy(np.int64)[row[i]]
        yield buffer, ids, tags, first[i], first[i] - starts[row[i]], many[i], anchor[i]


def _send_pieces(length: int, buckets: int, lot: int = 12 << 20):
    """Per bucket: documents, tags, places and sizes of its pieces, and their bytes, compressed."""

    def emit(found):
        ids, tags, place, size, anchor = (np.concatenate(x) for x in list(zip(*found))[:5])
        data = np.concatenate([x[5] for x in found])
        begin = np.cumsum(size) - size
        rows = [
            (b, _pack_ids(ids[i]), _pack(tags[i]), _pack(place[i]), _pack(size[i]), _squeeze(data[_spread(begin[i], size[i])].tobytes()))
            for b, i in _by_bucket(((anchor >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
        ]
        return pd.DataFrame(rows, columns=["bucket", "docs", "tags", "places", "sizes", "data"])

    def run(batches):
        found, held = [], 0
        for buffer, ids, tags, first, place, many, anchor in _wanted(batches, length, hot=False):
            if not len(ids):
                continue
            size = many + length - 1
            found.append((ids, tags, place, size, anchor, buffer[_spread(first, size)]))
            held += int(size.sum())
            if held > lot:
                yield emit(found)
                found, held = [], 0
        if found:
            yield emit(found)

    return run


def _hot_windows(length: int):
    def run(batches):
        for buffer, ids, tags, first, place, many, _ in _wanted(batches, length, hot=True):
            at = _spread(first, many)
            strings = np.lib.stride_tricks.sliding_window_view(buffer, length)[at].tobytes() if len(at) else b""
            yield pd.DataFrame(
                {
                    "string": [strings[i : i + length] for i in range(0, len(strings), length)],
                    "doc_id": np.repeat(ids, many),
                    "tag": np.repeat(tags, many),
                    "start": _spread(place, many).astype(np.int64),
                }
            )

    return run


def _ranges(flags: np.ndarray, owner: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the byte ranges under marked windows (owner by owner, at places one after the other)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    gap = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) != 0)) + 1
    a, b = at[np.concatenate(([0], gap))], at[np.concatenate((gap - 1, [len(at) - 1]))]
    return owner[a], place[a], place[b] + length


def _search_bucket(length: int, shard: int):
    """Byte ranges ``doc_id, tag, start, end`` of a bucket's pieces that a smaller document has too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([_unpack_ids(x) for x in group["docs"]])
        tag, place, size = (np.concatenate([_unpack(x) for x in group[c]]) for c in ("tags", "places", "sizes"))
        decompress = zstandard.ZstdDecompressor().decompress
        data = np.frombuffer(b"".join(decompress(x) for x in group["data"]), np.uint8)
        begin = np.cumsum(size) - size
        # equal pieces stand for one: the smallest document's
        names = np.array([int.from_bytes(hashlib.blake2b(data[a : a + n].tobytes(), digest_size=8).digest(), "little") for a, n in zip(begin.tolist(), size.tolist())], np.uint64)
        _, one, back = np.unique(names, return_index=True, return_inverse=True)
        if not np.array_equal(size[one][back], size) or not np.array_equal(data, data[_spread(begin[one][back], size)]):
            one = back = np.arange(len(size))
        least_doc = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, back, doc)
        least = least_documents(data[_spread(begin[one], size[one])], size[one], least_doc, length, shard)
        windows = size - length + 1
        window_base = np.cumsum(windows[one]) - windows[one]
        flags = least[_spread(window_base[back], windows)] < np.repeat(doc, windows)
        who, a, b = _ranges(flags, np.repeat(np.arange(len(size)), windows), _spread(place, windows), length)
        turn = np.lexsort((a, doc[who]))
        who, a, b = who[turn], a[turn], b[turn]
        return pd.DataFrame({"doc_id": doc[who], "tag": tag[who], "start": a, "end": b})

    return run


RANGE = "doc_id long, tag long, start long, end long"


def repeated_ranges(docs: DataFrame, length: int, hot: int, shard: int) -> DataFrame:
    """Byte ranges (they may overlap) of ``docs(doc_id, text, tag)`` that a smaller document has too."""
    spark = docs.sparkSession
    buckets = 4 * parts(spark)
    rows = docs.filter("doc_id IS NOT NULL")
    listed = rows.select("doc_id", "text").mapInPandas(
        _list_anchors(length, buckets, max(1, hot // 64)), "bucket int, docs binary, runs binary, anchors binary"
    )
    shared = listed.groupBy("bucket").applyInPandas(_shared_runs(hot), "doc_id long, run int")
    # dealt by id first: partial lists of a few numbers would be larger than the numbers
    dealt = shared.repartition(parts(spark), "doc_id")
    runs = saved(dealt.groupBy("doc_id").agg(F.collect_list("run").alias("runs"), F.min("run").alias("least")))
    wanted = rows.join(runs.hint("shuffle_hash"), "doc_id")
    sent = wanted.mapInPandas(
        _send_pieces(length, buckets), "bucket int, docs binary, tags binary, places binary, sizes binary, data binary"
    )
    ranges = saved(sent.groupBy("bucket").applyInPandas(_search_bucket(length, shard), RANGE))
    if not runs.filter("least < 0").limit(1).count():
        return ranges
    hot_rows = rows.join(runs.filter("least < 0").hint("shuffle_hash"), "doc_id")
    windows = saved(hot_rows.mapInPandas(_hot_windows(length), "string binary, doc_id long, tag long, start long"))
    least = windows.groupBy("string").agg(F.min("doc_id").alias("least"))
    later = windows.join(least, "string").filter("least < doc_id")
    return ranges.union(later.select("doc_id", "tag", "start", (F.col("start") + length).alias("end")))


def _marks(keys: DataFrame) -> DataFrame:
    """``doc_id, many, copies`` of the ids that need care: those of several rows, and copies of a smaller document.

    ``copies`` are the digests of its rows whose whole text a smaller document has too.
    Such a text goes as a whole, and its strings are all in the smaller document, so it
    takes no part in the search. A text that is everywhere is one row of the grouping.
    """
    first = keys.groupBy("same").agg(F.min("doc_id").alias("first"))
    found = keys.join(first, "same").select("doc_id", F.when(F.col("first") < F.col("doc_id"), F.col("same")).alias("copy"))
    marks = found.groupBy("doc_id").agg(F.count("*").alias("many"), F.collect_set("copy").alias("copies"))
    return marks.filter((F.col("many") > 1) | (F.size("copies") > 0))


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50, hot: int = 20_000, shard: int = 4 << 20
) -> DataFrame:
    """``doc_id, kept`` (the bytes left), ``n_bytes, n_removed, n_spans`` for each row of ``df``.

    Every byte goes that lies in a string of ``length`` bytes that also starts in a
    document with a smaller id; strings are judged on the input. Rows of one id never
    remove from each other. Null texts are empty. A row with a null id has no rank:
    nothing is removed from it or because of it. Other columns are not carried.
    ``hot`` parts ways of computing (see above), not results.

    The texts are written once to the shared folder as a table bucketed by id, so that
    neither later pass shuffles them; it is dropped when the result is saved.
    """
    spark = df.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"))
    name = f"dedup_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    docs.write.option("compression", "zstd").option("path", place).bucketBy(parts(spark), "doc_id").saveAsTable(name)
    try:
        with scratch(spark) as keep:
            return keep(_without_repeats(spark, name, length, hot, shard))
    finally:
        remove(spark, place, name)


def _without_repeats(spark: SparkSession, name: str, length: int, hot: int, shard: int) -> DataFrame:
    """The result for the table ``name`` of ``doc_id, text, same``."""
    marks = saved(_marks(spark.table(name).select("doc_id", "same").filter("doc_id IS NOT NULL")))
    docs = spark.table(name).join(marks.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id",
        "text",
        F.coalesce(F.array_contains("copies", F.col("same")), F.lit(False)).alias("copy"),
        F.when(F.col("many") > 1, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tag"),
    )
    ranges = repeated_ranges(docs.filter("NOT copy").drop("copy"), length, hot, shard).repartition(parts(spark), "doc_id")
    lists = ranges.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("start", "end")), F.collect_list("tag").alias("tags"))
    both = docs.join(lists.hint("shuffle_hash"), "doc_id", "left")

    def cut(batches):
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("doc_id", "text", "copy", "tag", "tags", "start", "end"))
            for doc, t, copy, tag, tags, start, end in zip(*columns):
                data = t.encode("utf-8", "surrogatepass")
                if copy and len(data) >= length:
                    out.append((doc, b"", len(data), len(data), 1))
                    continue
                if tags is None:
                    out.append((doc, data, len(data), 0, 0))
                    continue
                mine = np.asarray(tags) == tag
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, np.asarray(start)[mine], 1)
                np.add.at(change, np.asarray(end)[mine], -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, kept, len(data), len(data) - len(kept), spans))
            frame = pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])
            yield frame.astype({"doc_id": "Int64"})

    return both.mapInPandas(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


__all__ = ["anchor_runs", "common_prefixes", "least_documents", "substring_dedup", "suffix_array"]
