"""Media columns: lossless PNG images in binary columns and their hashes.

A payload of bytes becomes an 8-bit grey PNG whose rows are ``WIDTH`` bytes
wide.  Reading checks the signature and each chunk's CRC-32, inflates the IDAT
chunks, undoes the row filters with numpy, and derives a 64-bit hash from the
lowest frequencies of a cosine transform.

Defined cases: null text is the empty text; the empty text is one row of
spaces; equal texts give equal media and features; rows that repeat are
processed one by one; an empty table gives an empty table; columns other than
the id and the text are ignored.  A media value that is null or damaged gives
null features in ``media_features`` with ``strict=False`` and an error else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 192
#: Fixed by the PNG specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with spaces up to a positive multiple of ``width``."""
    return data.ljust(max(1, -(-len(data) // width)) * width, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    body = out[:, 1:]
    body[:] = rows
    if kind == 1:
        body[:, 1:] -= rows[:, :-1]
    elif kind == 2:
        body[1:] -= rows[:-1]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """A grey 8-bit PNG of the payload, whose length is a multiple of ``width``.

    Of the filters none, sub and up the one is taken under which the first 32
    rows deflate to the fewest bytes.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    kind = min((0, 1, 2), key=lambda k: len(zlib.compress(_filtered(rows[:32], k), 1)))
    body = zlib.compress(_filtered(rows, kind), level)
    head = struct.pack(">IIBBBBB", width, rows.shape[0], 8, 0, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", head)]
    parts += [_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter_row(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = np.empty_like(row), 0, 0
    for i, (x, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            x += (left + up) >> 1
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            x += left if a <= b and a <= c else up if b <= c else corner
        left, corner = x & 255, up
        out[i] = left
    return out


def _unfilter(raw: np.ndarray, width: int) -> np.ndarray:
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]).tolist()
    for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind, above = int(kinds[a]), out[a - 1] if a else np.zeros(width, np.uint8)
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            out[a] += above
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for i in range(a, b):
                out[i] = above = _unfilter_row(kind, out[i], above)
        elif kind:
            raise ValueError(f"PNG filter {kind} is unknown")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The grey samples of a PNG (rows x width); raises ValueError on damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(part, zlib.crc32(kind))):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("truncated PNG, or not 8-bit grey")
    width, height = size[:2]
    raw = zlib.decompressobj().decompress(b"".join(body), height * (width + 1) + 1)
    if len(raw) != height * (width + 1):
        raise ValueError("the samples do not fill the image")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1), width)


@lru_cache(maxsize=4)
def _cosines(keep: int, n: int) -> np.ndarray:
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


def cosine_hash(image: np.ndarray, side: int = 32, keep: int = 8) -> bytes:
    """``keep``^2 bits: which low frequencies lie above their median.

    The image is averaged down to side x side (rows repeat where there are
    fewer); the constant term is no bit.
    """
    height, width = image.shape
    cols = np.arange(side) * width // side
    thin = np.add.reduceat(image, cols, axis=1, dtype=np.float64) / np.diff(np.r_[cols, width])
    rows = np.arange(side) * height // side
    if height >= side:
        small = np.add.reduceat(thin, rows, axis=0) / np.diff(np.r_[rows, height])[:, None]
    else:
        small = thin[rows]
    basis = _cosines(keep, side)
    low = np.round(basis @ small @ basis.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


_MEDIA = "id long, n_bytes long, media binary"
_FEATURES = (
    "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, cosine_hash binary"
)
_FEATURE_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [b"" if x is None else x.encode() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([encode_png(pad(x)) for x in data], pa.binary())],
            ["id", "n_bytes", "media"],
        )


def _features(media: bytes) -> tuple:
    image = decode_png(media)
    payload = image.tobytes()
    low = cosine_hash(image)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), low.hex(), low)


def _reader(strict: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            found = []
            for x in batch.column(2).to_pylist():
                try:
                    found.append(_features(x if x is not None else b""))
                except (ValueError, zlib.error):
                    if strict:
                        raise
                    found.append((None,) * len(types))
            cols = list(zip(*found, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], _FEATURE_NAMES
            )

    return read


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a PNG."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode, _MEDIA)


def media_features(media: DataFrame, strict: bool = True) -> DataFrame:
    """Read the PNGs of ``encode_media`` back: digests and cosine hash."""
    return media.mapInArrow(_reader(strict), _FEATURES)
