"""Expected values for the fixture view, and a numpy cross-check."""

import numpy as np
import pytest

from kestrel.operators import aggregates, causal, clean
from kestrel.sources import tables as T

from conftest import SF_SMALL


def test_fixture_counts(spark):
    logs = T.load_logs(spark, SF_SMALL)
    r = logs.groupBy().agg({"error_count": "sum", "latency_ms": "avg", "event_id": "count"}).collect()[0]
    assert r["count(event_id)"] == 1000
    assert r["sum(error_count)"] == 135
    assert r["avg(latency_ms)"] == pytest.approx(82.0124, abs=1e-4)
    assert logs.where("level = 'WARN'").count() == 58


def test_ate_values(spark):
    logs = clean.drop_incomplete(T.load_logs(spark, SF_SMALL))
    ate = causal.ate_linear(logs).collect()[0]
    assert ate["ate"] == pytest.approx(0.00197057, abs=1e-8)
    het = causal.ate_hetero(logs).collect()[0]
    assert het["ate"] == pytest.approx(0.00196449, abs=1e-8)
    corr = aggregates.error_rate_corr(T.load_logs(spark, SF_SMALL)).collect()[0]
    assert corr["corr_lock_error"] == pytest.approx(0.678412, abs=1e-6)


def test_ate_equals_lstsq(spark):
    pdf = T.load_logs(spark, SF_SMALL).select("service", "pool_wait_ms", "db_lock_time", "error_count").toPandas()
    dummies = np.stack([(pdf["service"] == s).astype(float) for s in sorted(pdf["service"].unique())], axis=1)
    X = np.column_stack([pdf["pool_wait_ms"], pdf["db_lock_time"], dummies])
    beta = np.linalg.lstsq(X, pdf["error_count"].astype(float), rcond=None)[0][0]
    ate = causal.ate_linear(clean.drop_incomplete(T.load_logs(spark, SF_SMALL))).collect()[0]["ate"]
    assert ate == pytest.approx(beta, abs=1e-9)
