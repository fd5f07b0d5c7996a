"""Every catalogue query against its SQL counterpart on the same files."""

import duckdb
import numpy as np
import pytest

from lumenframe.plans import catalogue, files, values  # noqa: F401


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    plain = lambda v: float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_matches_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_filters_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["src13_deep_counts_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_byte_runs_stay_in_their_rows(spark, tmp_path):
    """No character is shuffled or sorted; an empty text has no byte; texts that share an id, null too, are one sequence of bytes."""
    texts = [(1, "aabšša"), (2, ""), (3, None), (4, "x" * 300 + "aš\n\n\U0001f600"), (5, "zz"), (None, "qqr")]
    again = [(6, "aab"), (6, "aab"), (6, None), (None, "qqr"), (7, None), (7, "ab")]
    for name, given in (("once", texts), ("again", texts + again)):
        spark.createDataFrame(given, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = catalogue.QUERIES["agg23_byte_runs"](spark, f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = con.sql(catalogue.ORACLES["agg23_byte_runs"]).df()
        if name == "once":
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not any(x in plan for x in ("Exchange", "Sort", "Window"))
        assert rows(found.toPandas()) == rows(want)
