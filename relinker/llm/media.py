"""Media columns: AVI with motion JPEG.

``store`` keeps bytes as the 8-bit samples of lossless JPEG frames (ITU-T T.81, process
14) in an AVI file; ``read_avi`` parses the RIFF index, ``decode_jpeg`` decodes intra
frames (lossless and baseline), and ``shots`` cuts a clip where the difference of
histograms exceeds an adaptive threshold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import ship

WIDTH, MOST_LINES, FPS = 64, 64, 25

#: The code of difference category s has 9 - s bits, and s bits follow: 9 bits a sample,
#: whatever the data, so that whole frames are coded without a loop over samples.
_DHT = bytes([0x00, *([1] * 9), *([0] * 7), *range(8, -1, -1)])


def _nine_bits() -> tuple[np.ndarray, np.ndarray]:
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        code[d + 255] = prefix << s | (d if d > 0 else d + (1 << s) - 1)
        back[code[d + 255]] = d
    return code, back


_CODE, _DIFFERENCE = _nine_bits()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_lossless(frame: np.ndarray) -> bytes:
    """A grey frame (height, width; a multiple of 8 samples) as lossless JPEG, predicted from the left."""
    high, wide = frame.shape
    x = frame.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, 1:] = x[:, 1:] - x[:, :-1]
    diff[1:, 0] = x[1:, 0] - x[:-1, 0]
    diff[0, 0] = x[0, 0] - 128
    code = _CODE[diff + 255].reshape(-1, 8).astype(np.uint16)
    packed = np.empty((len(code), 9), np.uint8)
    packed[:, 0] = code[:, 0] >> 1
    for i in range(1, 8):
        packed[:, i] = (code[:, i - 1] << (8 - i)) & 0xFF | code[:, i] >> (i + 1)
    packed[:, 8] = code[:, 7] & 0xFF
    head = b"\xff\xd8" + _segment(0xC4, _DHT) + _segment(0xC3, struct.pack(">BHHBBBB", 8, high, wide, 1, 1, 0x11, 0))
    return head + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + packed.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _unpack_nine(data: np.ndarray, n: int) -> np.ndarray:
    groups = data[: n // 8 * 9].reshape(-1, 9).astype(np.uint16)
    code = np.empty((len(groups), 8), np.uint16)
    for i in range(8):
        code[:, i] = (groups[:, i] << (i + 1) | groups[:, i + 1] >> (7 - i)) & 0x1FF
    return _DIFFERENCE[code.ravel()]


def _undo_prediction(diff: np.ndarray, first: int) -> np.ndarray:
    x = diff.astype(np.int64)
    x[0, 0] += first
    x[:, 0] = np.cumsum(x[:, 0])
    return (np.cumsum(x, axis=1) & 0xFFFF).astype(np.uint16)


class _Bits:
    """Bits of an entropy-coded segment, stuffing removed; zeros after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.have = self.have << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        self.need(n)
        self.n -= n
        out = self.have >> self.n
        self.have &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, s: int) -> int:
        if s == 16:
            return 32768
        v = self.take(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


_ZIGZAG = _zigzag()
_DCT = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

#: The Huffman tables that motion JPEG takes for granted (T.81, K.3): counts by length, then symbols.
_DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_LUMA = (
    bytes.fromhex("0002010303020403050504040000017d"),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9"
        "aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
_AC_CHROMA = (
    bytes.fromhex("00020102040403040705040400010277"),
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a6364656667"
        "68696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Samples (height, width, components) of a baseline or lossless JPEG image, as coded (YCbCr is not converted)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    quant: dict[int, np.ndarray] = {}
    raw = {0x00: _DC_LUMA, 0x01: _DC_CHROMA, 0x10: _AC_LUMA, 0x11: _AC_CHROMA}
    at, frame, kind, restart = 2, None, 0, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                raw[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC3):
            kind = marker
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            frame = (bits, high, wide, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            end = data.rfind(b"\xff\xd9")
            coded = data[at : end if end >= at else len(data)]
            if kind == 0xC3:
                return _lossless(frame, body, coded, raw, restart)
            return _baseline(frame, body, coded, raw, quant, restart)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"JPEG process {marker:#x} is not intra baseline or lossless")
    raise ValueError("no scan")


def _lossless(frame, scan: bytes, coded: bytes, raw, restart: int) -> np.ndarray:
    bits, high, wide, parts = frame
    if len(parts) != 1 or restart:
        raise ValueError("lossless frames of one component without restarts only")
    predictor, shift = scan[3], scan[5] & 15
    counts, symbols = raw[scan[2] & 0xF0]
    first, n = 1 << (bits - shift - 1), high * wide
    data = coded.replace(b"\xff\x00", b"\xff")
    if bytes([0, *counts, *symbols]) == _DHT and predictor == 1 and n % 8 == 0:
        diff = _unpack_nine(np.frombuffer(data, np.uint8), n).reshape(high, wide)
        return (_undo_prediction(diff, first) << shift)[:, :, None].astype(np.uint8 if bits <= 8 else np.uint16)
    table, stream = _huffman(counts, symbols), _Bits(data)
    x = np.zeros((high, wide), np.int64)
    for r in range(high):
        for c in range(wide):
            a, b = int(x[r, c - 1]) if c else 0, int(x[r - 1, c]) if r else 0
            q = int(x[r - 1, c - 1]) if r and c else 0
            if r and c:
                guess = (0, a, b, q, a + b - q, a + ((b - q) >> 1), b + ((a - q) >> 1), (a + b) >> 1)[predictor]
            else:
                guess = a if c else b if r else first
            x[r, c] = (guess + stream.signed(stream.symbol(table))) & 0xFFFF
    return (x << shift)[:, :, None].astype(np.uint8 if bits <= 8 else np.uint16)


def _baseline(frame, scan: bytes, coded: bytes, raw, quant, restart: int) -> np.ndarray:
    _, high, wide, parts = frame
    tables = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
    codes = {k: _huffman(*v) for k, v in raw.items()}
    most_h, most_v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 0x11, parts[0][2])], 1, 1
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    planes = [np.zeros((down * 8 * (p[1] & 15), across * 8 * (p[1] >> 4))) for p in parts]
    pieces, start = [], 0
    for i in range(len(coded) - 1):
        if coded[i] == 0xFF and 0xD0 <= coded[i + 1] <= 0xD7:
            pieces.append(coded[start:i])
            start = i + 2
    pieces.append(coded[start:])
    streams = iter(_Bits(p.replace(b"\xff\x00", b"\xff")) for p in pieces)
    stream, last = next(streams), [0] * len(parts)
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            stream, last = next(streams), [0] * len(parts)
        for k, (name, factors, q) in enumerate(parts):
            dc, ac = codes[tables[name] >> 4], codes[0x10 | tables[name] & 15]
            h, v = factors >> 4, factors & 15
            for b in range(h * v):
                flat = np.zeros(64)
                last[k] += stream.signed(stream.symbol(dc))
                flat[0], i = last[k], 1
                while i < 64:
                    rs = stream.symbol(ac)
                    if rs == 0:
                        break
                    i += rs >> 4
                    if rs & 15 and i < 64:
                        flat[i] = stream.signed(rs & 15)
                    i += 1
                block = np.zeros(64)
                block[_ZIGZAG] = flat * quant[q]
                samples = _DCT.T @ block.reshape(8, 8) @ _DCT + 128
                y, x = (mcu // across * v + b // h) * 8, (mcu % across * h + b % h) * 8
                planes[k][y : y + 8, x : x + 8] = samples
    out = [
        np.repeat(np.repeat(p, most_v // (c[1] & 15), axis=0), most_h // (c[1] >> 4), axis=1)[:high, :wide]
        for p, c in zip(planes, parts)
    ]
    return np.clip(np.rint(np.stack(out, axis=2)), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], wide: int, high: int, fps: int = FPS, note: bytes = b"") -> bytes:
    """An AVI file of motion-JPEG frames with an index; ``note`` goes to the stream's data chunk."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 2**32 - 1, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    stream = _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", note) if note else b"")
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", stream)) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


@dataclass
class Avi:
    fps: float = 0.0
    wide: int = 0
    high: int = 0
    note: bytes = b""
    frames: list[bytes] = field(default_factory=list)


def read_avi(data: bytes) -> Avi:
    """The first video stream's frames, from the index where there is one, else in file order.

    A dropped frame (an empty chunk) repeats the one before.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, index, movi = Avi(), b"", None

    def walk(at: int, end: int) -> None:
        nonlocal index, movi
        while at + 8 <= end:
            name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(end, body + size))
                else:
                    walk(body + 4, min(end, body + size))
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out.fps = rate / max(1, scale)
            elif name == b"strf" and not out.wide:
                out.wide, out.high = struct.unpack_from("<ii", data, body + 4)
            elif name == b"strd":
                out.note = data[body : body + size]
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + (size & 1)

    walk(12, len(data))
    if movi is None:
        raise ValueError("no frames")
    start, end = movi
    spots: list[tuple[int, int]] = []
    if index:
        entries = [struct.unpack_from("<4sIII", index, i) for i in range(0, len(index) - 15, 16)]
        entries = [(o, n) for name, _, o, n in entries if name[2:] in (b"dc", b"db")]
        base = start if entries and data[start + entries[0][0] : start + entries[0][0] + 4][2:] in (b"dc", b"db") else 0
        spots = [(base + o + 8, n) for o, n in entries]
    else:
        at = start + 4
        while at + 8 <= end:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                spots.append((at + 8, size))
            at += 12 if data[at : at + 4] == b"LIST" else 8 + size + (size & 1)
    for at, size in spots:
        out.frames.append(data[at : at + size] if size or not out.frames else out.frames[-1])
    return out


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.1) -> list[int]:
    """First frames of the shots, from rows of normalised histograms.

    A cut is where half the L1 difference exceeds ``floor`` and the mean of the
    ``window`` differences before it by ``factor`` times their mean deviation.
    """
    if not len(histograms):
        return []
    diff = 0.5 * np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    cuts = [0]
    for i, d in enumerate(diff):
        past = diff[max(0, i - window) : i]
        mean = past.mean() if len(past) else 0.0
        spread = np.abs(past - mean).mean() if len(past) else 0.0
        if d > max(floor, mean + factor * spread):
            cuts.append(i + 1)
    return cuts


def histogram(frame: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of the first component's samples in equal bins."""
    return np.bincount(frame[:, :, 0].ravel() >> 4, minlength=bins)[:bins] / max(1, frame.shape[0] * frame.shape[1])


def timed(histograms: np.ndarray, fps: float) -> list[tuple[int, int, float, float]]:
    """First frame, number of frames, start and end in seconds of each shot."""
    starts = shots(histograms)
    return [(a, b - a, a / fps, b / fps) for a, b in zip(starts, [*starts[1:], len(histograms)])]


def clips(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each shot of each AVI: id, ``clip, first_frame, frames, start_s, end_s, mean`` and ``error``.

    Null media give no rows; bytes that are no motion-JPEG AVI give one row whose
    ``error`` says why and whose other values are null. Null ids and repeated rows are kept.
    """
    schema = "id string, clip int, first_frame int, frames int, start_s double, end_s double, mean double, error string"

    def cut(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch["id"].tolist(), batch["media"].tolist()):
                try:
                    avi = read_avi(bytes(media))
                    if not avi.fps:
                        raise ValueError("no frame rate")
                    got = [decode_jpeg(f) for f in avi.frames]
                except (ValueError, struct.error, IndexError, KeyError, StopIteration) as e:
                    rows.append((name, None, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                shares = np.array([histogram(g) for g in got]).reshape(-1, 16)
                for k, (a, n, start, end) in enumerate(timed(shares, avi.fps)):
                    mean = float(np.mean([g[:, :, 0].mean() for g in got[a : a + n]]))
                    rows.append((name, k, a, n, start, end, mean, None))
            names = [f.split()[0] for f in schema.split(", ")]
            whole = {c: "Int32" for c in ("clip", "first_frame", "frames")}
            yield pd.DataFrame(rows, columns=names).astype(whole)

    media = df.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")).filter("media IS NOT NULL")
    return media.mapInPandas(cut, schema)


def store(payload: bytes) -> bytes:
    """Bytes (a multiple of 64) as lossless grey frames of 64 samples a line in an AVI; the note is their number.

    Frames share one height of at most 64 lines; the last is filled with zeros.
    """
    lines = len(payload) // WIDTH
    count = -(-lines // MOST_LINES)
    high = -(-lines // count)
    samples = np.zeros((count * high, WIDTH), np.uint8)
    samples[:lines] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [encode_lossless(f) for f in samples.reshape(count, high, WIDTH)]
    return write_avi(frames, WIDTH, high, note=struct.pack("<Q", len(payload)))


def read_back(media: bytes) -> tuple[bytes, list[np.ndarray], Avi]:
    """The bytes of ``store`` again, with the frames that they were read from."""
    avi = read_avi(media)
    frames = [decode_jpeg(f) for f in avi.frames]
    (size,) = struct.unpack("<Q", avi.note)
    return b"".join(f.tobytes() for f in frames)[:size], frames, avi


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``df``: its text stored as an AVI, read back, and digests and features of that.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, clips``. The feature has the number of frames and shots, the mean
    sample, and the histogram's largest bin with its share; ``clips`` has each shot's
    first frame, number of frames, start and end in seconds. A null text is empty (one
    line of zeros). Narrow: one row at a time, nothing is shuffled; null ids and
    repeated rows stay; other columns are not carried.
    """
    ship(df.sparkSession)

    @F.pandas_udf(
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
        " feature string, clips string"
    )
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            media = store(padded(data))
            back, frames, avi = read_back(media)
            shares = np.array([histogram(f) for f in frames])
            mean = sum(float(f.sum(dtype=np.int64)) for f in frames) / sum(f.size for f in frames)
            top = int(np.argmax(shares.mean(axis=0)))
            found = timed(shares, avi.fps)
            feature = f"frames={len(frames)};shots={len(found)};mean={mean:.3f};top={top}:{shares[:, top].mean():.4f}"
            rows.append(
                (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                 ",".join(f"{a}+{n}:{start:.3f}-{end:.3f}" for a, n, start, end in found))
            )
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
        return pd.DataFrame(rows, columns=names)

    docs = df.select(F.col(id_col).alias("doc_id"), stored(F.col(text_col)).alias("m"))
    return docs.select("doc_id", "m.*")
