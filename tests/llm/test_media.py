import hashlib
import struct
import zlib

import numpy as np
import pytest
from conftest import SMALL

from churnlens.llm import media
from llm.cases import awkward, none


def filtered(image, kinds):
    """A PNG of image whose rows take the filters named, written out plainly."""
    h, w = image.shape
    rows, px = [], image.astype(int)
    for y in range(h):
        row = [kinds[y]]
        for x in range(w):
            a, b, c = (px[y][x - 1] if x else 0), (px[y - 1][x] if y else 0), (px[y - 1][x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((px[y][x] - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        rows.append(bytes(row))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    z = zlib.compress(b"".join(rows))
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", z[:5]) + media._chunk(b"IDAT", z[5:]) + media._chunk(b"IEND", b"")


def test_all_filters_are_undone():
    rng = np.random.default_rng(2)
    for most in (1, 3, 5):
        image = rng.integers(0, 256, (40, 24), dtype=np.uint8)
        assert (media.decode_png(filtered(image, rng.integers(0, most, 40).tolist())) == image).all()
    assert (media.decode_png(filtered(image, [2] * 40)) == image).all()


def test_broken_files_are_told():
    png = media.encode_png(b"abc" * 192)
    for bad in (png[:-1], b"x" + png[1:], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:33]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def check(docs):
    rows = media.media_digests(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\xff" * ((576 - len(raw) % 576) % 576 or (0 if raw else 576))
        want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        png = media.encode_png(p)
        assert media.decode_png(png).tobytes() == p
        want[-1] += (len(png), hashlib.sha256(png).hexdigest(), media.cosine_hash(np.frombuffer(p, np.uint8).reshape(-1, 24)))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_payloads_come_back(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert media.media_digests(none(spark)).count() == 0


def test_hash_bears_small_changes():
    rng = np.random.default_rng(4)
    smooth = np.repeat(rng.integers(20, 230, (24, 24), dtype=np.uint8), 2, axis=0)
    noisy = np.clip(smooth.astype(int) + rng.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    a, b, c = (int(media.cosine_hash(x), 16) for x in (smooth, noisy, rng.integers(0, 256, (48, 24), dtype=np.uint8)))
    assert (a ^ b).bit_count() < (a ^ c).bit_count()
