"""Physical-plan properties the scale design relies on."""

import pytest

from kestrel.plans.queries import QUERIES

from conftest import SF_SMALL


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_batch", "knn_filtered", "edge_last100", "distinct_messages"])
def test_topk_is_partial_before_shuffle(spark, name):
    plan = _plan(spark, name)
    assert plan.count("WindowGroupLimit") >= 2 or "Partial" in plan


def test_time_filter_reaches_scan(spark):
    plan = _plan(spark, "recent_errors")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "log_store", "feedback",
                                                                                   "src_", "sink_", "submissions",
                                                                                   "edge_append", "cooldown",
                                                                                   "reachability", "knn_lsh",
                                                                                   "text_embed"))))
def test_no_cartesian_product(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["error_burst", "error_burst_global", "topology_edges", "edge_last100",
                                  "node_state", "burst_sliding", "edge_obs_match", "scenario_match"])
def test_no_single_partition_exchange(spark, name):
    # Windows over rows are partitioned (key and/or time bucket); nothing is
    # funnelled through one task.
    assert "SinglePartition" not in _plan(spark, name)


def test_aggregates_are_partial(spark):
    plan = _plan(spark, "ate_linear")
    assert "partial_covar_pop" in plan or "partial_" in plan


def test_forecast_joins_per_series_side_by_broadcast(spark):
    """Pass 2 of the fit must not shuffle rows: the per-series side is broadcast."""
    plan = _plan(spark, "forecast_fit")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _exec_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_plans_have_no_cartesian_or_single_partition_row_window(spark):
    """The skew-bounded plans (forced) partition every row-level window."""
    from pyspark.sql import functions as F

    from kestrel.functions.scans import previous_in_order
    from kestrel.operators.timeseries import trailing_count
    from kestrel.sources import tables as T

    logs = T.load_logs(spark, SF_SMALL)
    tc = _exec_plan(trailing_count(logs.where(F.col("error_count") >= 1).select("event_id", "timestamp", "service"),
                                   300 * 10**6, ["service"]))
    lag = _exec_plan(previous_in_order(logs.select("user_id", "timestamp", "event_id", "service"), "user_id",
                                       ["timestamp", "event_id"], "service", "prev"))
    for plan in (tc, lag):
        assert "CartesianProduct" not in plan
    assert "SinglePartition" not in tc
    # The range-partitioned rows are written once; the plan reads them with their partition numbers.
    assert "_p:int" in lag


def test_cluster_conf_sizes_partitions():
    from kestrel.session import cluster_conf

    big = cluster_conf(10**14, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100_000
    small = cluster_conf(10**8, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 256 << 20
