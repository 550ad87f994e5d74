"""Every registered query with an oracle gives the oracle's rows."""

import math

import pandas as pd
import pytest

from hexaphase.plans import catalog


def rows_of(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) else float(v)

    rows = [tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)]
    return list(df.columns), sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(name, spark, sf, duck):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


def test_entry_is_a_registered_query():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_no_python_in_native_plans(spark, sf):
    for name in ("epoch_axis", "sliding_windows", "nms_topk", "dft_power", "hop_window_overlap", "p2_lookup"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_scans_read_only_what_they_use(spark, sf):
    plan = catalog.QUERIES["epoch_axis"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
