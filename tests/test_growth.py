"""Plans whose cost must not grow faster than their input."""

import re

from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.operators.sequence import as_of, attributed_to
from usagelake.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_frame_from_the_row_to_the_end(spark):
    rows = spark.createDataFrame([("f", 1, False), ("f", 2, True), ("f", 3, False), ("f", 4, True), ("g", 1, False)], "f string, at int, own boolean")
    near = rows.select("f", "at", attributed_to(F.col("own"), F.col("at"), ["f"], ["at"]).alias("near"), attributed_to(F.col("own"), F.col("at"), ["f"], ["at"], following_only=True).alias("next"))
    assert sorted(map(tuple, near.collect())) == [("f", 1, 2, 2), ("f", 2, 2, 2), ("f", 3, 2, 4), ("f", 4, 4, 4), ("g", 1, None, None)]
    found = as_of(rows.select("f", "at"), rows.where("own").withColumn("name", F.col("at")), ["f"], "at", "at", "name", "at", "out")
    assert sorted(map(tuple, found.collect())) == [("f", 1, 2), ("f", 2, 2), ("f", 3, 2), ("f", 4, 4), ("g", 1, None)]
    for df in (near, found):
        assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan(df))


def test_records_are_parsed_once(spark, tmp_path):
    texts = ['{"a": {"b": 1}}', ' \t{"a": 2}', "[1]", '"x"', "3", '{"a": ', "", None, "null", "﻿7"]
    spark.createDataFrame([(t,) for t in texts], "value string").write.parquet(str(tmp_path / "t"))
    rows = v.records(spark.read.parquet(str(tmp_path / "t"))).withColumn("n", v.count(F.col("v"), "$.a.b", "$.a")).where((v.text(F.col("v"), "$.a.b") != "") | (F.col("n") > 0))
    assert sorted(r.n for r in rows.collect()) == [1, 2]
    assert plan(rows).count("parse_json") + plan(rows).count("tryParseJson") <= 1


def test_identity_pairs_no_part_with_each_supplier(spark):
    joins = [line for line in plan(queries.project_identity(spark, "/root/testdata/sf0.001")).splitlines() if "p_partkey" in line and "Join" in line]
    assert not joins
