"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`encode` and `decode` implement the format itself; `to_gif`, `frames` and `digest` apply it to DataFrame columns in one
pass without a shuffle. A text's bytes become 8-bit samples (palette indices) of a timed animation, losslessly.

The LZW decoder works on whole arrays: code widths depend only on a code's place after a clear code, so the codes of a
segment are cut out at once; an entry's string is a stretch of earlier output, so each output sample points to an
earlier one and pointer doubling resolves all of them in a logarithmic number of rounds.

Null text counts as empty (one unit of padding); equal texts give equal files; repeated rows give repeated rows; an
empty table gives an empty table; other columns aren't read by `digest`, and a column named like the output of `to_gif` is
replaced. A very long text makes frames of bounded size, coded and decoded in one task, which holds some 20 bytes a byte. A
damaged file raises ValueError in `decode`; in `frames` it is a row of its key with nulls, so that none is lost silently.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the payload contract: samples in a unit, filler byte.
UNIT, FILLER = 576, 255
#: A unit is WIDTH x 6 samples; a frame holds at most FRAME_UNITS units.
WIDTH, FRAME_UNITS = 96, 128
DELAY_CS = 10
_TABLE = 4096


@dataclass
class Frame:
    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    #: RGBA canvas as shown while this frame is up
    canvas: np.ndarray


def default_palette() -> np.ndarray:
    """256 colours: 3 bits of red, 3 of green, 2 of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], 1).astype(np.uint8)


# LZW


def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the codes 0 .. n-1 after a clear code."""
    following = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, bits + 1, 12)


_cumulative: dict[int, np.ndarray] = {}


def _offsets(bits: int, n: int) -> np.ndarray:
    """Bit offsets (n + 1) of the codes after a clear code."""
    if len(_cumulative.get(bits, ())) <= n:
        _cumulative[bits] = np.concatenate([[0], np.cumsum(_widths(bits, max(n, _TABLE + 2)))])
    return _cumulative[bits][: n + 1]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of `samples`, each below 2 ** bits; the table is cleared whenever it is full."""
    clear, first = 1 << bits, (1 << bits) + 2
    codes = [clear]
    add, known = codes.append, {}
    get, following = known.get, first
    source = iter(samples)
    prefix = next(source, None)
    for sample in source:
        pair = prefix << 8 | sample
        if (code := get(pair)) is not None:
            prefix = code
            continue
        add(prefix)
        known[pair] = following
        following += 1
        prefix = sample
        if following == _TABLE:
            add(clear)
            known.clear()
            following = first
    if prefix is not None:
        add(prefix)
    add(clear + 1)
    segment = _TABLE - first + 1  # codes from one clear to the next, the next included
    place = (np.arange(len(codes) - 1)) % segment
    width = np.concatenate([[bits + 1], _widths(bits, segment)[place]])
    at = np.concatenate([[0], np.cumsum(width)])
    total = int(at[-1] + 7) // 8
    at = at[:-1]
    value, byte = np.asarray(codes, np.int64) << (at & 7), at >> 3
    out = sum(np.bincount(byte + k, value >> 8 * k & 255, total + 3) for k in range(3))
    return out[:total].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples that the codes after a clear code stand for."""
    base, n = clear + 2, len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    entry = codes >= base
    parent = np.where(entry, codes - base, np.arange(n))
    if entry[0] or (parent[entry] >= np.flatnonzero(entry)).any():
        raise ValueError("LZW code before its entry")
    hops, to = entry.astype(np.int64), parent.copy()
    while True:
        more = hops[to]
        if not more.any():
            break
        hops, to = hops + more, to[to]
    length = hops + 1
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    source = np.repeat(start[parent] - start, length) + np.arange(total)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    literal = np.zeros(total, np.uint8)
    literal[start[~entry]] = codes[~entry]
    return literal[source]


def lzw_decode(stream: bytes, bits: int, expected: int) -> np.ndarray:
    clear, n_bits = 1 << bits, len(stream) * 8
    a = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    window = a[:-2] | a[1:-1] << 8 | a[2:] << 16
    out, position, got, most = [], 0, 0, _TABLE + 1
    while got < expected:
        n = min(most, (n_bits - position) // (bits + 1))
        offsets = _offsets(bits, max(n, 0))
        n = int(np.searchsorted(offsets, n_bits - position, "right")) - 1
        if n < 1:
            break
        at, width = offsets[:n] + position, np.diff(offsets[: n + 1])
        codes = window[at >> 3] >> (at & 7) & (1 << width) - 1
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(special) and n == most:  # the encoder went on with a full table
            most = n_bits
            continue
        end = int(special[0]) if len(special) else n
        out.append(_expand(codes[:end], clear))
        got += len(out[-1])
        if not len(special) or codes[end] == clear + 1:
            break
        position += int(offsets[end + 1])
        most = _TABLE + 1
    samples = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(samples) < expected:
        raise ValueError(f"LZW stream has {len(samples)} of {expected} samples")
    return samples[:expected]


# Files


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b)]) + b for b in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(frames: list[dict], width: int, height: int, palette: np.ndarray | None = None) -> bytes:
    """A GIF89a file. A frame: indices (2-d), and maybe left, top, delay_cs, disposal, transparent, palette, interlaced."""
    shared = default_palette() if palette is None else palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | _depth(shared), 0, 0), _padded(shared)]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for f in frames:
        indices, clear = np.ascontiguousarray(f["indices"], np.uint8), f.get("transparent")
        flags = f.get("disposal", 0) << 2 | (clear is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, f.get("delay_cs", 0), clear or 0, 0))
        own, rows = f.get("palette"), indices.shape[0]
        local = 0 if own is None else 0x80 | _depth(own)
        if f.get("interlaced"):
            local |= 0x40
            indices = indices[_interlaced(rows)]
        out.append(b"," + struct.pack("<HHHHB", f.get("left", 0), f.get("top", 0), indices.shape[1], rows, local))
        if own is not None:
            out.append(_padded(own))
        bits = max(2, int(indices.max(initial=0)).bit_length())
        out += [bytes([bits]), _blocks(lzw_encode(indices.tobytes(), bits))]
    return b"".join([*out, b";"])


def _depth(palette: np.ndarray) -> int:
    return max(0, (len(palette) - 1).bit_length() - 1)


def _padded(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes().ljust(3 * (2 << _depth(palette)), b"\0")


def _interlaced(rows: int) -> np.ndarray:
    """Row numbers in the order in which an interlaced image stores them."""
    r = np.arange(rows)
    return np.concatenate([r[0::8], r[4::8], r[2::4], r[1::2]])


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a file, each with the canvas as shown."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF ends early") from e


def _decode(data: bytes) -> tuple[int, int, list[Frame]]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        at += 3 * n
        if at > len(data):
            raise ValueError("GIF ends early")
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(out)

    if flags & 0x80:
        shared = palette(flags)
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9:
                packed, delay, index, *_ = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown GIF block {data[at]}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(local) if local & 0x80 else shared
        if colours is None:
            raise ValueError("GIF image without a palette")
        bits = data[at]
        at += 1
        indices = lzw_decode(blocks(), bits, w * h).reshape(h, w)
        if local & 0x40:
            stored, indices = indices, np.empty_like(indices)
            indices[_interlaced(h)] = stored
        before = canvas.copy() if disposal == 3 else None
        # what lies outside of the screen isn't shown
        seen = indices[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        full = np.zeros((256, 4), np.uint8)
        full[: len(colours), :3], full[:, 3] = colours, 255
        if transparent is None:
            area[:] = full[seen]
        else:
            drawn = seen != transparent
            area[drawn] = full[seen[drawn]]
        frames.append(Frame(delay, disposal, transparent, left, top, w, h, indices, colours, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return width, height, frames


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible samples by colour: 2 bits each of red, green and blue make 64 bins."""
    c = canvas.reshape(-1, 4)
    bins = c[:, 0] >> 6 << 4 | c[:, 1] >> 6 << 2 | c[:, 2] >> 6
    return np.bincount(bins[c[:, 3] > 0], minlength=64)


# Columns


def payload(text: bytes) -> bytes:
    """The text's bytes with the filler up to a positive multiple of a unit."""
    return text + bytes([FILLER]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def from_bytes(data: bytes) -> bytes:
    """A timed animation of the payload: whole frames, then one lower frame with the rest."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    step = FRAME_UNITS * UNIT // WIDTH
    parts = [{"indices": samples[i : i + step], "delay_cs": DELAY_CS, "disposal": 1} for i in range(0, len(samples), step)]
    return encode(parts, WIDTH, min(step, len(samples)))


def to_bytes(frames: list[Frame]) -> bytes:
    return b"".join(f.indices.tobytes() for f in frames)


def to_gif(df: DataFrame, text: str = "text", out: str = "gif") -> DataFrame:
    """`df` with its text stored as a GIF file in a binary column."""

    @F.pandas_udf("binary")
    def work(texts):
        return texts.map(lambda x: from_bytes(payload((x or "").encode())))

    return df.withColumn(out, work(F.col(text)))


def frames(df: DataFrame, gif: str = "gif", key: str = "doc_id") -> DataFrame:
    """One row per frame: key, frame_no, start_cs, delay_cs, left, top, width, height, indices, histogram (64 bins)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, frame_no int, start_cs int, delay_cs int, `left` int, top int, width int, height int, indices binary, histogram array<long>"
    names = [key, "frame_no", "start_cs", "delay_cs", "left", "top", "width", "height", "indices", "histogram"]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    _, _, found = decode(data or b"")
                except ValueError:
                    found = []
                rows, start = [], 0
                for i, f in enumerate(found):
                    rows.append((k, i, start, f.delay_cs, f.left, f.top, f.width, f.height, f.indices.tobytes(), histogram(f.canvas).tolist()))
                    start += f.delay_cs
                rows = rows or [(k, *[None] * 9)]
                kinds = [batch.schema.field(0).type, *[pa.int32()] * 7, pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return df.select(key, gif).mapInArrow(work, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: what its payload, stored as GIF and read back, is; feature: share of each of 64 colours per mille."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                media = from_bytes(payload(data))
                _, _, found = decode(media)
                back = to_bytes(found)
                colours = sum(histogram(f.canvas[: f.height]) for f in found)
                feature = ",".join(map(str, (colours * 1000 // max(1, int(colours.sum()))).tolist()))
                rows.append((doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
