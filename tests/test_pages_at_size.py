"""Pages and order lines at size: folded in their tasks, dealt to more tasks the more there are."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import layout
from textloom.sources import views


@pytest.fixture(scope="module")
def boxes(spark):
    # pages of 0 to 40 boxes; the last one is larger than a task folds
    b = spark.range(41).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("idx"))
    place = lambda k, m: (F.abs(F.xxhash64("page", "idx", F.lit(k))) % m).cast("double")
    return b.select("page", "idx", place(1, 550).alias("x"), place(2, 700).alias("y"), (place(3, 40) + 1).alias("w"), (place(4, 20) + 1).alias("h")).localCheckpoint()


def test_components_folded_and_by_rounds_agree(spark, boxes):
    rows = lambda most: {tuple(r) for r in layout.with_components(boxes, layout.same_column(), most).select("page", "idx", "component").collect()}
    assert rows(100) == rows(32) == rows(0)
    assert len(rows(32)) == boxes.count() and len({c for p, _, c in rows(32) if p == 40}) > 1


def test_small_pages_are_dealt_once(spark, boxes):
    small = layout.page_components(boxes.filter("page < 20").repartition(5, "page"), layout.same_column())
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_most_open_is_the_sweep(spark):
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 9.0), (1, 4.0, 6.0), (2, 1.0, 2.0)], "page int, top double, bottom double")
    own = spans.groupBy("page").agg(layout._most_open(F.collect_list(F.struct("top", "bottom"))).alias("most"))
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in layout.sweep_maximum(spans, "page", "top", "bottom").collect()} == {(1, 2), (2, 1)}


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    least = spark.sparkContext.defaultParallelism
    assert views.line_tasks(spark, d) == least
    monkeypatch.setattr(views, "TASK_LINES", 500)
    assert views.line_tasks(spark, d) == -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500) > least
    plan = views.lines(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(l_orderkey" in plan and f"{views.line_tasks(spark, d)})" in plan


def test_table_coverage_counts_rows_not_cells(spark):
    from textloom.registry import QUERIES

    covered = QUERIES["g24_table_coverage"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in covered._jdf.queryExecution().executedPlan().toString()
    assert covered.filter("covered").count() == covered.count() > 0
