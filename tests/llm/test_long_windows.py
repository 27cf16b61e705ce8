import numpy as np

from veilsift.llm.substring_dedup import repeated_in_shard


def test_windows_beyond_the_usual_depth():
    """Segments that agree on long runs and then differ, so that suffixes sorted too shallowly lie in the wrong order."""
    r = np.random.default_rng(4)
    window, run = 150, r.integers(1, 3, 140)
    parts = [np.concatenate([r.integers(1, 3, r.integers(0, 40)), run, r.integers(1, 3, 60)]) for _ in range(12)]
    parts += [np.concatenate([parts[k], r.integers(1, 3, 9)]) for k in (0, 3)] + [np.full(400, 7)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    names = np.arange(len(parts))
    segment, first, last = repeated_in_shard(names, np.ones(len(parts), np.int64), np.concatenate(parts).astype(np.uint64), offsets, window)
    got = {(int(s), i) for s, a, b in zip(segment, first, last, strict=True) for i in range(a, b)}
    seen = {}
    for s, p in enumerate(parts):
        for i in range(len(p) - window + 1):
            seen.setdefault(p[i : i + window].tobytes(), []).append((s, i))
    assert got == {x for places in seen.values() if len(places) > 1 for x in places}
