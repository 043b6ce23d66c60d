"""Driver contract: entry() runs on sf0.001; a sample of queries equals its DuckDB twin at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
SAMPLE = ["label_events", "ordered_split", "stratified_split", "library_split", "knn_classify", "binary_metrics",
          "smote", "auc", "feature_rank", "change_table", "stream_counts"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    from oracle_check import connect, digest

    sp = E.queries()[name](spark, SF).toPandas()
    od = connect(SF).sql(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(od.columns)
    assert len(sp) == len(od)
    assert digest(sp)[0] == digest(od)[0]


def test_every_query_has_an_oracle_except_model_outputs():
    import __spark_entry__ as E
    from flowlab.plans import catalog

    rows_only = {"isolation_forest", "lodo_rf", "nested_lodo", "other_models", "rf_importance", "rf_three_config", "transfer_rf"}
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) - set(o) == rows_only
    assert set(catalog.QUERIES) <= set(q) and set(o) <= set(q)
