import hashlib
import struct
import zlib

import numpy as np
import pytest

from relinker.llm import media, registry


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = registry.op8_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = media.padded(data)
        stored = media.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 4160, 300_000])
def test_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    assert media.read_back(media.store(payload))[0] == payload


def test_nine_bit_codes_are_the_canonical_huffman_codes():
    frame = np.random.default_rng(1).integers(0, 256, (5, 16), dtype=np.uint8)
    coded = media.encode_lossless(frame)
    table, scan = media._huffman(media._DHT[1:17], media._DHT[17:]), coded.index(b"\xff\xda")
    stream = media._Bits(coded[scan + 10 : -2].replace(b"\xff\x00", b"\xff"))
    diff = np.array([stream.signed(stream.symbol(table)) for _ in range(80)]).reshape(5, 16)
    assert (media._undo_prediction(diff, 128) == frame).all()
    assert (media.decode_jpeg(coded)[:, :, 0] == frame).all()


def put(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def code(table, symbol):
    counts, symbols = table
    return next(format(c, f"0{n}b") for (n, c), s in media._huffman(counts, symbols).items() if s == symbol)


def number(v):
    s = abs(v).bit_length()
    return s, (format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else "")


def baseline(blocks, high, wide, parts, quant=1):
    """blocks: per block (component, dc difference, {zigzag place: value}); the default tables, so no DHT."""
    bits = ""
    for comp, dc, ac in blocks:
        tables = (media._DC_LUMA, media._AC_LUMA) if comp == 0 else (media._DC_CHROMA, media._AC_CHROMA)
        s, extra = number(dc)
        bits += code(tables[0], s) + extra
        at = 1
        for place, v in sorted(ac.items()):
            while place - at > 15:
                bits += code(tables[1], 0xF0)
                at += 16
            s, extra = number(v)
            bits += code(tables[1], (place - at) << 4 | s) + extra
            at = place + 1
        bits += code(tables[1], 0)
    comps = b"".join(bytes([i + 1, f, 0]) for i, f in enumerate(parts))
    scan = bytes([len(parts)]) + b"".join(bytes([i + 1, 0x00 if i == 0 else 0x11]) for i in range(len(parts))) + b"\0\x3f\0"
    return (
        b"\xff\xd8" + media._segment(0xDB, bytes([0] + [quant] * 64))
        + media._segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(parts)) + comps)
        + media._segment(0xDA, scan) + put(bits) + b"\xff\xd9"
    )


def test_baseline_grey_with_ac():
    image = np.random.default_rng(2).integers(0, 256, (8, 8))
    coefficients = np.rint(media._DCT @ (image - 128.0) @ media._DCT.T).astype(int).ravel()[media._ZIGZAG]
    ac = {i: int(v) for i, v in enumerate(coefficients) if i and v}
    got = media.decode_jpeg(baseline([(0, int(coefficients[0]), ac)], 8, 8, [0x11]))
    assert np.abs(got[:, :, 0].astype(int) - image).max() <= 1
    sparse = media.decode_jpeg(baseline([(0, 0, {40: 9, 63: -3})], 8, 8, [0x11]))
    assert sparse.std() > 0


def test_baseline_subsampled_colour():
    luma = [(0, 80, {}), (0, -160, {}), (0, 80, {}), (0, 0, {})]
    got = media.decode_jpeg(baseline([*luma, (1, 400, {}), (2, -400, {})], 15, 13, [0x22, 0x11, 0x11]))
    assert got.shape == (15, 13, 3)
    assert got[0, 0].tolist() == [138, 178, 78] and got[0, 12, 0] == 118 and got[14, 0, 0] == 128


def movie(levels):
    frames = []
    for k, level in enumerate(levels):
        noise = np.random.default_rng(k).integers(0, 8, (16, 16))
        frames.append(media.encode_lossless((level + noise).astype(np.uint8)))
    return frames


def test_shots_and_clips(spark):
    avi = media.write_avi(movie([16] * 12 + [160] * 7 + [96] * 9), 16, 16, fps=10)
    still = bytearray(avi)
    struct.pack_into("<I", still, avi.index(b"vidsMJPG") + 24, 0)
    rows = [("a", avi), ("b", b"RIFF"), ("c", None), (None, avi[: avi.index(b"idx1")]), ("d", bytes(still))]
    df = spark.createDataFrame(rows, "id string, media binary").withColumnRenamed("id", "clip")
    got = media.clips(df, "clip", "media").collect()
    for name in ("a", None):
        mine = sorted((r.clip, r.first_frame, r.frames, r.start_s, r.end_s) for r in got if r.id == name)
        assert mine == [(0, 0, 12, 0.0, 1.2), (1, 12, 7, 1.2, 1.9), (2, 19, 9, 1.9, 2.8)]
    assert [r.error for r in got if r.id == "d"] == ["no frame rate"]
    assert [r.error for r in got if r.id == "b"] == ["not an AVI file"] and not [r for r in got if r.id == "c"]
    assert media.clips(df.limit(0), "clip", "media").collect() == []


def test_index_with_file_offsets_and_dropped_frame():
    frames = movie([10, 200])
    avi = bytearray(media.write_avi([frames[0], b"", frames[1]], 16, 16))
    assert media.read_avi(bytes(avi)).frames == [frames[0], frames[0], frames[1]]
    at, base = avi.rindex(b"idx1") + 8, avi.index(b"movi")
    for i in range(3):
        (offset,) = struct.unpack_from("<I", avi, at + 16 * i + 8)
        struct.pack_into("<I", avi, at + 16 * i + 8, offset + base)
    assert media.read_avi(bytes(avi)).frames == [frames[0], frames[0], frames[1]]


def test_edges(spark):
    rows = [(1, None, 5), (None, "", 6), (2, "é" * 100_000, 7), (2, "é" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m int")
    got = media.text_media(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 0, 64), (1, 0, 64), (2, 200_000, 200_000), (2, 200_000, 200_000)]
    assert len({r.media_sha256 for r in got}) == 2
    for r in got:  # shots follow each other without a gap and cover all frames
        spans = [tuple(map(int, c.split(":")[0].split("+"))) for c in r.clips.split(",")]
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert r.feature.startswith(f"frames={sum(n for _, n in spans)};shots={len(spans)};")
    assert media.text_media(df.limit(0)).collect() == []
