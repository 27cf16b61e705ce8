"""Pixel tests of images that the package's own PNG reader does not decode."""

import struct
import zlib

import numpy as np
import pytest

from veilsift.functions import image as im
from veilsift.operators import image_checks, scan
from veilsift.sources import files, images


def natural(seed):
    return np.clip(np.random.default_rng(seed).normal(128, 40, (64, 64, 3)), 0, 255).astype(np.uint8)


def bmp(px):
    h, w, _ = px.shape
    body = px[::-1, :, ::-1].tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def grey_png(px):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + line.tobytes() for line in px)
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg(spark, path, px):
    """Written by the Java library that the image source reads with."""
    jvm = spark.sparkContext._jvm
    h, w, _ = px.shape
    out = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            out.setRGB(x, y, int(px[y, x, 0]) << 16 | int(px[y, x, 1]) << 8 | int(px[y, x, 2]))
    assert jvm.javax.imageio.ImageIO.write(out, "jpg", jvm.java.io.File(path))


def test_formats_of_the_image_source_are_analysed(spark, tmp_path):
    a, b = natural(5), natural(10)
    (tmp_path / "a b.bmp").write_bytes(bmp(a))
    (tmp_path / "g.png").write_bytes(grey_png(b[:, :, 0]))
    (tmp_path / "w.webp").write_bytes(b"RIFF\x40\0\0\0WEBPVP8 " + bytes(60))
    jpeg(spark, str(tmp_path / "j.jpg"), a[:16, :16])
    got = {r.filename: r.triage for r in image_checks.triage_files(spark, str(tmp_path)).collect()}
    want = lambda px: pytest.approx((im.chi_square_of(px), im.regular_singular_of(px), im.sample_pairs_of(px)))
    stats = lambda t: (t.scores["chi_square"], t.scores["rs_analysis"], t.scores["spa"])
    assert stats(got["a b.bmp"]) == want(a[:, :, 0]) and got["a b.bmp"].is_suspicious
    assert stats(got["g.png"]) == want(b[:, :, 0]) and "chi_square" in got["j.jpg"].scores
    assert got["w.webp"].recommended_action == "not_analysed" and "chi_square" not in got["w.webp"].scores
    docs = image_checks.with_pixels(spark, files.read_documents(spark, str(tmp_path)), str(tmp_path))
    whole = {r.filename: r for r in scan.scan(docs).collect()}
    assert stats(whole["a b.bmp"]) == want(a[:, :, 0]) and not whole["a b.bmp"].safe and whole["w.webp"].recommended_action == "not_analysed"


def test_grey_channels(spark, tmp_path):
    px = natural(1)[:5, :4, 0]
    (tmp_path / "g.png").write_bytes(grey_png(px))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in image_checks.channels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): (int(px[y, x]),) * 3 for y in range(5) for x in range(4)}
