"""Plans keep each rule's pattern once, run no Python and shuffle nothing."""

import pytest
from guardloom.functions.rules import CREDENTIALS, INBOUND, PERSONAL
from guardloom.operators import inbound, outbound


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(1, "a", "public")], "id long, text string, surface string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "select",
    [
        lambda d: d.select("id", "threat_level"),
        lambda d: d.where("threat_level = 'high'").select("id"),
        lambda d: d.where("needs_judge").select("id", "risk_score"),
        lambda d: d.groupBy("threat_level").count(),
    ],
)
def test_inbound_patterns_are_evaluated_once(texts, select):
    text = plan(select(inbound.check_inbound(texts)))
    # each rule once, the blank test, and the markdown scan's keyword and target tests
    assert text.count("RLIKE") <= len(INBOUND) + 8
    assert "Python" not in text and "Arrow" not in text


def test_outbound_patterns_are_evaluated_once(texts):
    text = plan(outbound.check_outbound(texts).where("blocked").select("id"))
    # each rule once, and the blank test for each list of rules
    assert text.count("RLIKE") <= len(PERSONAL) + len(CREDENTIALS) + 4


def test_checks_do_not_shuffle(texts):
    assert "Exchange" not in plan(outbound.sanitize(inbound.check_inbound(texts).select("id", "text", "surface")))


def test_only_needed_columns_are_read(texts):
    text = plan(outbound.check_outbound(texts.withColumn("extra", texts["id"])).select("id", "threat_level"))
    assert "ReadSchema: struct<id:bigint,text:string,surface:string>" in text
