"""The parsed settings are worked out once a row, however often they are named."""

from pyspark.sql import functions as F

from voxelloom.sources import specs


def test_lines_are_sorted_once(spark):
    texts = spark.createDataFrame([("a", "k: 1\nj = 2\nk: 3 # new\nplain"), ("b", "")], "spec string, text string")
    parsed = specs.parse_specs(texts)
    assert sorted(map(tuple, parsed.select("spec", F.explode("settings")).collect())) == [("a", "j", "2"), ("a", "k", "3")]
    assert parsed.where("spec = 'b'").first().settings == {}
    # Spark adds a filter with two conditions on them below the generator; with the projection they stand three times.
    plan = texts.where("spec <> 'z'").transform(specs.parse_specs).select("spec", F.explode("settings"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") <= 3
