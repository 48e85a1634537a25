import pandas as pd
import pytest

import __spark_entry__ as entry
from logsluice.oracles import ORACLES
from logsluice.queries import QUERIES


def rows(df):
    def plain(v):
        return None if pd.isna(v) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, duck, sf_small, name):
    got = QUERIES[name](spark, sf_small).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_gapfill_reaches_the_last_window(spark, sf_small):
    some = QUERIES["window_10s_aggregate"](spark, sf_small).toPandas()
    got = QUERIES["window_10s_gapfill"](spark, sf_small).toPandas()
    assert len(got) == (some["window_start_ms"].max() - some["window_start_ms"].min()) // 10_000 + 1
    assert got["events_in"].sum() == some["events_in"].sum()


def test_all_records_are_governed(spark, duck, sf_small):
    n = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    stats = QUERIES["request_stats"](spark, sf_small).toPandas()
    assert stats["records_in"].sum() == QUERIES["namespace_keep_rate"](spark, sf_small).toPandas()["records"].sum() == n
    kept = QUERIES["govern_logs"](spark, sf_small).toPandas()
    assert len(kept) == stats["kept"].sum() and (kept["event_id"] % 10 == 0).any()
    assert kept["attrs"].str.startswith("user.email=[EMAIL]\n").all()
