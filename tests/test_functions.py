"""Scalar functions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from usagelake.functions import language, paths, text, times, tokens
from usagelake.functions.evidence import dominant, of_payload, text_paths
from usagelake.functions.patches import diff_counts, envelope_changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("/a/./b/../c//d", "/a/c/d"), ("", "."), ("a/..", "."), ("../x", "../x"), ("/..", "/"), ("a//b/", "a/b"), ("../../a/../b", "../../b")])
def test_clean(spark, path, want):
    assert one(spark, paths.clean(F.lit(path))) == want


@pytest.mark.parametrize(("root", "entity", "want"), [("/p", "/p/src/a.go", "src/a.go"), ("/p", "/q/a.go", "a.go"), ("", "/q/a.go", "a.go"), ("/p", "", ""), ("/p", "/p", "."), ("/p/q", "/p/x", "x"), ("/p", "rel/a.go", "a.go")])
def test_relative_entity(spark, root, entity, want):
    assert one(spark, paths.relative_entity(F.lit(root), F.lit(entity))) == want


@pytest.mark.parametrize(("path", "want"), [("README.md", "Markdown"), ("page.tsx", "TypeScript"), ("x/Makefile", "Makefile"), ("a.h", "C"), ("noext", "Unknown"), ("'q.py'", "Python"), ("go.mod", "Go"), ("a.unknownext", "Unknown")])
def test_language_of(spark, path, want):
    assert one(spark, language.language_of(F.lit(path))) == want


def test_evidence():
    assert dominant([("README.md", 1), ("page.tsx", 3), ("api.ts", 1)]) == "TypeScript"
    assert dominant([("a.h", 2), ("b.mm", 1)]) == "Objective-C++" and dominant([("a.h", 1)]) == "C" and dominant([]) == "Unknown"
    assert text_paths("edit `/r/x1.go`, (b.tsx) and c.nope") == ["/r/x1.go", "b.tsx"]
    assert dominant(of_payload({"arguments": '{"file_path": "a.rs", "command": "cat b.py"}'})) == "Rust"


@pytest.mark.parametrize(("raw", "want"), [("2026-05-21T10:00:00.123Z", "2026-05-21T10:00:00.123Z"), ("2026-05-21T12:00:00+02:00", "2026-05-21T10:00:00Z"), ("2026-05-21", None), ("1770983427123", "2026-02-13T11:50:27.123Z"), ("1770983427.5", "2026-02-13T11:50:27.5Z"), ("0", None), ("x", None), ("", None)])
def test_timestamps(spark, raw, want):
    assert one(spark, times.rfc3339_nano(times.parse_timestamp(F.lit(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [("12", 12), (" 12.9 ", 12), ("-3", 0), ("nan", 0), ("18446744073709551615", 2**63 - 1), ("1e3", 1000), ("", 0), (None, 0)])
def test_counter(spark, raw, want):
    assert one(spark, tokens.counter(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("content", "want"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_count_lines(spark, content, want):
    assert one(spark, text.count_lines(F.lit(content))) == want


def test_patches(spark):
    body = "*** Begin Patch\n*** Add File: n.py\n+a\n*** Update File: o.go\n*** Move to: m.go\n-x\n+y\n+z\n*** Delete File: d.c\n*** End Patch"
    found = one(spark, envelope_changes(F.lit(body)))
    assert [(c.path, c.lines_added, c.lines_removed) for c in found] == [("n.py", 1, 0), ("m.go", 2, 1), ("d.c", 0, 0)]
    assert one(spark, F.size(envelope_changes(F.lit(body.replace("*** Begin Patch", ""))))) == 0
    assert tuple(one(spark, diff_counts(F.lit("--- a\n+++ b\n+x\n-y\n-z")))) == (1, 2)
