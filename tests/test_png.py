"""PNG bytes: every filter, large pictures, and small files that unpack to much."""

import struct
import time
import zlib

import numpy as np
import pytest

from veilsift.sources import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, color, packed, parts=1, more=b""):
    step = -(-len(packed) // parts)
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + more + b"".join(chunk(b"IDAT", packed[a : a + step]) for a in range(0, len(packed), step)) + chunk(b"IEND", b"")


def filtered(px, kinds):
    """The lines of px as differences, cell by cell."""
    height, width, n = px.shape
    at = lambda y, x, c: int(px[y, x, c]) if y >= 0 and x >= 0 else 0
    out = bytearray()
    for y in range(height):
        out.append(kinds[y])
        for x in range(width):
            for c in range(n):
                a, b, d = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
                p = a + b - d
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out.append((int(px[y, x, c]) - [0, a, b, (a + b) // 2, nearest][kinds[y]]) & 255)
    return bytes(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 9, 3), (9, 1, 3), (7, 12, 3), (12, 7, 4), (2, 2, 2), (5, 5, 1)])
def test_every_filter(shape):
    rng = np.random.default_rng(sum(shape))
    px = rng.integers(0, 256, shape, dtype=np.uint8)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[shape[2]]
    for kinds in ([k % 5 for k in range(shape[0])], [4] * shape[0], [3] * shape[0], [k % 3 for k in range(shape[0])]):
        data = png(shape[1], shape[0], color, zlib.compress(filtered(px, kinds)), parts=3)
        assert np.array_equal(images.png_pixels(data), px)


def test_large_picture_takes_no_loop_over_bytes():
    lines = np.full((1500, 1 + 2000 * 3), 4, np.uint8)
    start = time.perf_counter()
    px = images.png_pixels(png(2000, 1500, 2, zlib.compress(lines.tobytes(), 1)))
    assert px.shape == (1500, 2000, 3) and time.perf_counter() - start < 20


def test_small_files_that_unpack_to_much():
    packer = zlib.compressobj(9)
    bomb = b"".join(packer.compress(bytes(1 << 20)) for _ in range(1024)) + packer.flush()
    assert images.png_pixels(png(40000, 40000, 2, bomb)) is None
    assert np.array_equal(images.png_pixels(png(4, 4, 2, bomb)), np.zeros((4, 4, 3), np.uint8))
    assert images.png_pixels(png(4, 4, 2, zlib.compress(b"\0\1"))) is None
    (name, value), = images.metadata(png(1, 1, 0, zlib.compress(b"\0\1"), more=chunk(b"zTXt", b"note\0\0" + bomb)))
    assert name == "note" and len(value) == images.MAX_FIELD_BYTES
