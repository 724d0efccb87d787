"""Reached limits and when they end."""

import json

from pyspark.sql import functions as F

from usagelake.functions.times import limit_reset
from usagelake.providers.stateful import claude_limits

SAID = "Claude AI usage limit reached"


def test_the_second_after_the_first_bar(spark):
    cases = [
        (f"x {SAID}|1700000000 y", True, 1700000000), (f"{SAID} (soon) |17", True, 17), (f"{SAID}|17", False, None), (f"{SAID}|17", None, None), (f"{SAID}| 17", True, None), (f"{SAID}", True, None),
        (f"|5 {SAID}", True, None), (f"{SAID}|no {SAID}|17", True, None), (f"{SAID}|0", True, None), (f"{SAID}|99999999999999999999", True, None), (f"{SAID}|{10**13}", True, None), ("other|17", True, None), ("", True, None), (None, True, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, line string, error boolean, want bigint")
    found = rows.select("i", F.unix_seconds(limit_reset(F.col("line"), F.col("error"))).alias("at"), "want").orderBy("i").collect()
    assert [(r.i, r.at) for r in found] == [(r.i, r.want) for r in found]


def test_rows_that_tell_of_a_limit(spark, tmp_path):
    def line(n, text, **more):
        return json.dumps({"timestamp": f"2026-01-02T03:04:{n:02d}Z", "message": {"id": f"m{n}", "content": text, "usage": {"input_tokens": 0}}, **more}, separators=(",", ":"))

    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    lines = [line(1, f"{SAID}|1700000000", isApiErrorMessage=True), line(2, f"{SAID}|1700000000"), line(3, "all well", isApiErrorMessage=True), json.dumps({"isApiErrorMessage": True, "text": f"{SAID}|5"})]
    (folder / "a.jsonl").write_text("\n".join(lines))
    assert [(r.source_start, r.timestamp.second, int(r.resets_at.timestamp()) if r.resets_at.tzinfo else r.resets_at.year) for r in claude_limits(spark, [str(tmp_path)]).collect()] == [(0, 1, 2023)]
