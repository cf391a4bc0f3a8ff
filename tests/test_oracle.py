"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewatch.plans import catalogue, fixtures
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in fixtures.RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_condition_and_every_series_has_rows_in_sql(duck):
    from tidewatch.plans import rules

    fired = {r[0] for r in duck.sql(f"SELECT DISTINCT alertname FROM ({catalogue.ORACLES['a1_evaluate_rules']})").fetchall()}
    assert fired == {a.name for a in rules.ALERT_RULES}
    recorded = {r[0] for r in duck.sql(f"SELECT DISTINCT rec FROM ({catalogue.ORACLES['m21_record_rules']})").fetchall()}
    assert recorded == {r.name for r in rules.RECORDING_RULES if not r.name.startswith("_")}


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows_of(rel.columns, rel.fetchall())
