"""Operator 4: payloads as PNG images in a binary column, read back and hashed by low-frequency cosine transform."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm.common import staged, text_of

SIDE = 24
BLOCK = SIDE * SIDE
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LOW = 8
_k = np.arange(SIDE)
COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:LOW, None] / (2 * SIDE)) * np.where(_k[:LOW, None] == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str) -> tuple[bytes, int]:
    """The text's UTF-8 filled with bytes 255 up to a positive multiple of 576, and its own length."""
    raw = text.encode()
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, width: int = SIDE, level: int = 6) -> bytes:
    """8-bit grey image of the bytes, row by row; each row takes the None, Sub or Up filter of least absolute sum."""
    image = np.frombuffer(data, np.uint8).reshape(-1, width)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    options = np.stack([image, sub, up])
    best = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.empty((len(image), width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = options[best, np.arange(len(image))]
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; raises ValueError where the signature, a length or a checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data, end = png[at + 8 : at + 8 + n], at + 12 + n
        if end > len(png) or zlib.crc32(kind + data) != struct.unpack_from(">I", png, end - 4)[0]:
            raise ValueError(f"broken chunk {kind!r}")
        yield kind, data
        at = end


def _sequential(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Unfilter row by row; needed for Average and Paeth, where each byte waits for its left neighbour."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        if kind < 3:
            out[y] = (rows[y], np.cumsum(rows[y], dtype=np.uint8), rows[y] + above)[kind]
        else:
            left = corner = 0
            for x, (v, b) in enumerate(zip(rows[y].tolist(), above.tolist(), strict=True)):
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                left, corner = (v + guess) & 255, b
                out[y, x] = left
        above = out[y]
    return out


def unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows without their filters. None, Sub and Up need no loop: an Up row is the last other row plus a running sum."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if kinds.max(initial=0) > 2:
        return _sequential(rows, kinds)
    out = rows.copy()
    out[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
    if (is_up := kinds == 2).any():
        total = np.cumsum(np.where(is_up[:, None], rows, 0), axis=0, dtype=np.uint8)
        last = np.maximum.accumulate(np.where(is_up, -1, np.arange(len(rows))))
        known = (last >= 0)[:, None]
        out = np.where(is_up[:, None], total + np.where(known, out[last] - total[last], 0), out)
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG without interlacing; raises ValueError if it is broken or of another kind."""
    parts: dict[bytes, bytes] = {}
    for kind, data in chunks(png):
        parts[kind] = parts.get(kind, b"") + data
    if not {b"IHDR", b"IDAT", b"IEND"} <= parts.keys():
        raise ValueError("chunks are missing")
    width, height, *kind = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if kind != [8, 0, 0, 0, 0]:
        raise ValueError("not 8-bit grey")
    try:
        raw = zlib.decompress(parts[b"IDAT"])
    except zlib.error as e:
        raise ValueError("broken stream") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 1:], rows[:, 0])


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine terms of the image, averaged down to 24 x 24, exceed their median."""
    small = image.reshape(SIDE, -1, SIDE).mean(axis=1)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the PNG of each whole text's payload. Null text counts as empty: 576 bytes 255.

    Null and repeated doc_ids are kept as rows; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                made = [payload(t.as_py()) for t in part.column(1)]
                columns = [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p) for p, _ in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and cosine hash of each stored image, from the pixels as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for doc_id, n, png in zip(*(c.to_pylist() for c in b.columns), strict=True):
                image = decode_png(png)
                back = image.tobytes()
                rows.append((doc_id, n, len(back), sha(back), zlib.crc32(back[-32:]), len(png), sha(png), cosine_hash(image)))
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in FEATURES_DDL.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES_DDL)


def media_digests(docs: DataFrame) -> DataFrame:
    """to_media stored as Parquet in the shared folder (already deflated, so not compressed again) and features of what was stored."""
    return features(staged(to_media(docs), codec="uncompressed"))
