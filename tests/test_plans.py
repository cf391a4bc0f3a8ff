"""Shape of the plans."""

import pytest

from tidewatch.plans import catalogue
from tidewatch.sources import tables as stored

SF = "/root/testdata/sf0.001"
# These write or run a whole catalogue before they return; tests/test_recording.py and tests/test_alert_runs.py look at such plans.
EAGER = ("m21_record_rules", "a1_evaluate_rules", "a7_", "a11_", "p9_erase_stored", "s7_upsert_sink", "t2_stored", "s3_", "s4_", "s5_", "s6_", "s14_", "s15_", "s16_", "s17_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith(EAGER)])
def test_no_cartesian_product_and_no_row_python(name, spark):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "FlatMapGroupsInPandas" not in text


def test_partition_filter_reaches_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "logs")
    stored.write_daily_partitions(tables.app_logs, path, "logs")
    d = stored.read_index_pattern(spark, path, "logs", "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("event_id")
    text = plan(d)
    assert "PartitionFilters: [" in text and "log_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(ts)" in text


def test_time_filter_and_columns_are_pushed_down(spark, tables):
    from tidewatch.operators import search

    text = plan(search.time_filter(tables.events, "24h", "2024-01-20 12:00:00").select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp>" in text


def test_compliance_facts_carry_only_what_rules_read(tables):
    from tidewatch.plans import q_ops

    assert not {"input_tokens", "latency_ms", "team"} & set(q_ops.compliance_facts(tables).columns)


def test_cooldowns_read_written_alerts(tables):
    from tidewatch.plans import q_alerts

    kept = q_alerts.kept_alerts(tables)
    assert kept.columns == ["ts", "name", "category", "entity"]
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
