"""Regions that lie in one place meet the rows once, and every region keeps its rows."""

from strandline.operators import intervals

ROWS = [(1, "s", "a", 5, 9), (2, "s", "a", 500_000, 500_010), (3, "s", None, 8, 40), (4, "s", "b", 60, 70), (5, "t", None, 5, 9), (6, "s", "c", 15, 1_030)]


def table(spark):
    return spark.createDataFrame(ROWS, "row_id long, seqid string, source_id string, start long, end long")


def test_regions_of_one_place_meet_rows_once_and_come_back_apart(spark):
    regions = spark.createDataFrame([(f"r{i}", "s", 1, 10) for i in range(2_500)] + [("x", "s", 69, 80)], "region string, seqid string, start long, end long")
    found = intervals.rows_in_regions(table(spark), regions)
    assert {(r.region, r.row_id) for r in found.collect()} == {(f"r{i}", n) for i in range(2_500) for n in (1, 3)} | {("x", 4), ("x", 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_regions" in plan and found.count() == 5_002


def test_a_second_look_finds_no_row_again(spark):
    regions = spark.createDataFrame([("r", "s", 10, 20)], "region string, seqid string, start long, end long")
    seqs = spark.createDataFrame([("s", 1_000, True)], "seqid string, length long, circular boolean")
    found = intervals.rows_in_regions(table(spark), intervals.with_second_look(regions, seqs))
    assert sorted(r.row_id for r in found.collect()) == [3, 6]  # 6 lies in both looks


def test_whole_features_are_found_without_pairs(spark):
    regions = spark.createDataFrame([(f"r{i}", "s", 1, 10 + i % 2) for i in range(50)], "region string, seqid string, start long, end long")
    found = intervals.touched_features(table(spark), regions)
    assert sorted(r.row_id for r in found.collect()) == [1, 2, 3]
    assert "Generate explode(_regions" not in found._jdf.queryExecution().optimizedPlan().toString()
