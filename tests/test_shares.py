"""Shares and means that lie on a rounding limit."""

from pyspark.sql import functions as F

from voxelloom.operators import porosity


def marked(spark, pores, total):
    rows = [("a", z, pore, n) for z, k in enumerate(pores) for pore, n in ((True, k), (False, total - k))]
    return spark.createDataFrame(rows, "volume_id string, z int, pore boolean, n bigint")


def test_a_share_is_rounded_once(spark):
    one = marked(spark, [87], 320)  # 27.1875 %, but 87 / 320 * 100 is below
    region = one.withColumn("region", F.lit(True))
    found = [porosity.volume_stats(one), porosity.region_porosity(region), porosity.volume_porosity(one), porosity.slice_porosity(one)]
    found += [porosity.volume_and_slice_report(one), porosity.porosity_profile(region)]
    assert {r.porosity for rows in found for r in rows.collect()} == {27.1875}
    lines = porosity.format_report(porosity.volume_stats(one).withColumn("porosity", F.round("porosity", 3)), "Text")
    assert lines.where("line_no = 2").first().line == "Overall porosity: 27.1880%"


def test_a_mean_of_shares_does_not_depend_on_the_order(spark):
    pores = [434, 462, 430, 440, 461, 471, 490, 438]
    exact = 100 * sum(pores) / (560 * len(pores))
    for order in (pores, pores[::-1], sorted(pores), sorted(pores)[::-1]):
        rows = marked(spark, order, 560).coalesce(1)
        found = [porosity.volume_stats(rows), porosity.slice_porosity_stats(rows), porosity.region_porosity(rows.withColumn("region", F.lit(True)))]
        assert [r.mean_porosity for part in found for r in part.collect()] == [exact] * 3


def test_empty_slices_have_no_share(spark):
    rows = marked(spark, [1, 3], 4).unionByName(spark.createDataFrame([("a", 2, True, 0)], "volume_id string, z int, pore boolean, n bigint"))
    for found in (porosity.volume_stats(rows).first(), porosity.slice_porosity_stats(rows, percent=False).first()):
        assert found.n_slices == 2 and found.mean_porosity in (50.0, 0.5)
