"""Plan shapes the operators promise."""

import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
NATIVE = [
    "flagship", "mask_semi", "mask_then_mode", "hex_join", "hex_join_salted", "hex_join3", "assign_then_sum",
    "unique_cells_sum", "overlay_share", "presence_share", "rollup_fraction", "line_share", "clip_length",
    "zonal_stats", "pyramid_parent_avg", "build_tiles", "asset_paths", "column_dictionary", "href_rewrite",
]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_pair_loops(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for word in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_sums_shuffle_partial_results(spark, sf):
    plan = QUERIES["aggregate_cells"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_sum" in below and plan.count("Exchange hashpartitioning") == 1


def test_geometry_runs_on_distinct_cells(spark, sf):
    plan = QUERIES["area_by_group"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("HashAggregate", plan.index("ArrowEvalPython"))
    assert plan.count("ArrowEvalPython") == 1


def test_disks_are_found_once_per_cell(spark, sf):
    """Of the distinct cells and of their distinct neighbours: never of a raster's rows, nor of pairs."""
    plan = QUERIES["grid_disk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    tree = [line for line in plan.splitlines() if "ArrowEvalPython" in line or "Aggregate" in line]
    kinds = ["disk" if "ArrowEvalPython" in line else "aggregate" for line in tree]
    assert kinds == ["disk", "aggregate", "aggregate", "disk", "aggregate", "aggregate"]
