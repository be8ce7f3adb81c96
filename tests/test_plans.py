import __spark_entry__ as entry_points
import pytest
from noteloom.operators import retrieval as R
from noteloom.plans import catalogue, inputs as I


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_catalogue(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    df = entry_points.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
    assert len(catalogue.QUERIES) == sum(len(p.QUERIES) for p in catalogue._PARTS)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_plan_multiplies_tables(spark, sf_dir, name):
    _, physical = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_scans_read_only_what_they_need(spark, sf_dir):
    lines = I.embedded_lines(spark, sf_dir)
    _, keyword = plan(R.keyword_statistics(lines))
    assert "ArrowEvalPython" not in keyword and "ReadSchema: struct<text:string>" in keyword
    _, physical = plan(catalogue.QUERIES["session_ttl"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in physical
    _, physical = plan(catalogue.QUERIES["last_n_turns"](spark, sf_dir))
    assert "WindowGroupLimit" in physical
