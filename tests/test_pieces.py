"""Long files are tailed by more tasks than there are files."""

from usagelake.sources import tail


def test_a_long_file_is_tailed_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PIECE", 64)
    path = tmp_path / "a.jsonl"
    path.write_text("".join('{"n": %d}\n' % (n * 7919) for n in range(50)) + "open")
    reader = tail.TailReader({"path": str(tmp_path)})
    spans = reader.partitions({}, reader.latestOffset())
    rows = [row for span in spans for row in reader.read(span)]
    assert len(spans) > 5 and [r[3] for r in rows] == list(range(1, 52))
    assert [r[4] for r in rows[1:]] == [r[5] for r in rows[:-1]] and rows[0][4] == 0 and [r[7] for r in rows] == [True] * 50 + [False]
