"""Physical-plan checks: no cross products anywhere, pruned scans, the kNN kernel where expected."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
MODEL_FITS = {"rf_importance", "rf_three_config", "transfer_rf", "transfer_rf_supports", "lodo_rf", "nested_lodo", "other_models"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_no_cross_products_in_any_query(spark):
    from flowlab.plans import catalog

    bad = {}
    for name, fn in catalog.QUERIES.items():
        if name in MODEL_FITS:
            continue
        plan = _plan(fn(spark, SF))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def _scanned_columns(plan: str) -> list[list[str]]:
    return [[c.split("#")[0] for c in cols.split(",")] for cols in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_scans_are_pruned(spark):
    import __spark_entry__ as E

    q = E.queries()
    spark.catalog.clearCache()  # a cached relation from another test would replace the scan in the plan
    for name in ("stratified_split", "device_summary", "label_consistency"):
        scans = _scanned_columns(_plan(q[name](spark, SF)))
        assert scans, name
        for cols in scans:
            if "event_id" in cols or "user_id" in cols:
                assert "props" not in cols and "value" not in cols, (name, cols)
    scans = _scanned_columns(_plan(q["duplicates"](spark, SF)))
    assert scans and all(len(c) == len(spark.read.parquet(f"{SF}/lineitem.parquet").columns) for c in scans)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", ["eda_features", "quality"])
def test_summaries_read_their_table_once(spark, name):
    import __spark_entry__ as E

    spark.catalog.clearCache()
    assert len(_scanned_columns(_plan(E.queries()[name](spark, SF)))) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_knn_plan_uses_cogrouped_kernel(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["knn_classify"](spark, SF))
    assert "FlatMapCoGroupsInPandas" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
