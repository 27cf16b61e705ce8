import json

from veilsift.streaming import requests as q


def line(i, kind="scan_content", content="plain words"):
    return json.dumps({"request_id": f"r{i}", "sent": f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z", "type": kind, "content": content, "content_type": "text/plain"})


def test_repeats_broken_lines_and_a_replayed_batch(spark, tmp_path):
    """Requests sent again, broken and unknown lines, a restart, and a batch whose end was never recorded."""
    path, source = tmp_path / "run", tmp_path / "lines"
    source.mkdir()
    first = [line(1), "{broken", line(2, "dance"), "", json.dumps({"type": "scan_content", "content": "no id"}), line(1)]
    second = [line(3, content="zero​width​marks​"), line(2, "dance"), "[1, 2]"]
    third = [line(4), line(3), line(1)]
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    for k, lines in enumerate((first, second)):
        (source / f"{k}.txt").write_text("\n".join(lines))
        q.answer(stream(), str(path))
    told = lambda: sorted(tuple(r) for r in q.answers(spark, str(path)).select("request_id", "seq", "event", "data").collect())
    before = told()
    commits = path / "checkpoint" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    q.answer(stream(), str(path))
    assert told() == before
    (source / "2.txt").write_text("\n".join(third))
    q.answer(stream(), str(path))
    got = {}
    for key, seq, event, data in told():
        got.setdefault(key, []).append((seq, event, data))
    assert sorted(got) == ["r1", "r2", "r3", "r4"]
    assert [e for _, e, _ in got["r1"]] == ["start", "progress", "tier", "complete"] == [e for _, e, _ in got["r4"]]
    assert got["r2"] == [(0, "error", "unknown message type: dance")]
    assert [s for s, _, _ in got["r3"]] == list(range(len(got["r3"]))) and "threat" in [e for _, e, _ in got["r3"]]
    assert json.loads(got["r3"][-1][2])["safe"] is False
