"""Statistics of tiled pictures against the functions for whole ones."""

import numpy as np
import pytest

from veilsift.functions import image as im
from veilsift.operators import image_tiles

SCHEMA = "image string, x0 int, y0 int, width int, height int, data binary, note string"


def cut(rng, name, px):
    """A random tiling: bands of lines, each cut at columns of its own."""
    height, width = px.shape
    lines = [0, *sorted(rng.choice(np.arange(1, height), min(3, height - 1), replace=False).tolist()), height] if height > 1 else [0, 1]
    for y, end in zip(lines, lines[1:]):
        columns = [0, *sorted(rng.choice(np.arange(1, width), min(int(rng.integers(0, 7)), width - 1), replace=False).tolist()), width] if width > 1 else [0, 1]
        for x, stop in zip(columns, columns[1:]):
            yield (name, x, y, stop - x, end - y, px[y:end, x:stop].tobytes(), "n")


def test_any_tiling_gives_the_whole_picture(spark):
    rng = np.random.default_rng(7)
    shapes = [(20, 33), (1, 1), (3, 2), (9, 64), (40, 4), (2, 7), (16, 15)]
    pictures = {f"p{i}": np.clip(rng.normal(128, 3 + 10 * i, shape), 0, 255).astype(np.uint8) for i, shape in enumerate(shapes)}
    pictures["smooth"] = np.tile(np.arange(50, dtype=np.uint8) * 2, (11, 1)) + rng.integers(0, 2, (11, 50), dtype=np.uint8)
    for _ in range(2):
        rows = [t for name, px in pictures.items() for t in cut(rng, name, px)]
        tiles = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SCHEMA)
        got = {r.image: r for r in image_tiles.statistics(tiles.repartition(3)).collect()}
        assert set(got) == set(pictures)
        for name, px in pictures.items():
            want = (px.size, 0, im.entropy_of(px), im.chi_square_of(px), im.regular_singular_of(px), im.sample_pairs_of(px))
            assert tuple(got[name])[1:] == pytest.approx(want, abs=1e-9), name


def test_odd_tiles(spark):
    rows = [("a", 0, 0, 2, 2, b"\1\2\3\4", "x"), ("a", 0, 2, 2, 2, b"\1", "x"), ("a", 0, 4, 2, 1, None, None), ("b", None, 0, 1, 1, b"\1", "x"), (None, 0, 0, 1, 1, b"\7", "x"), ("c", 0, 0, 0, 5, b"", "x")]
    got = {r.image: r for r in image_tiles.statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["a"].n_pixels, got["a"].n_broken) == (4, 2) and got["a"].entropy == pytest.approx(2.0)
    assert tuple(got["b"])[1:] == (0, 1, 0.0, 0.0, 0.0, 0.0) and got[None].n_pixels == 1 and got["c"].n_broken == 1
    assert image_tiles.statistics(spark.createDataFrame([], SCHEMA)).count() == 0
