"""The corpus passes are narrow and read the columns they need."""

import re

import pytest

from waymill.llm.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(("name", "columns"), [("p6_ids", {"doc_id", "text"}), ("p8_passages", {"doc_id", "text", "lang"})])
def test_no_shuffle(spark, data, name, columns):
    text = plan(QUERIES[name](spark, data))
    assert "Exchange" not in text
    assert {c.split(":")[0] for c in re.search(r"ReadSchema: struct<(.*?)>\n", text).group(1).split(",")} == columns


@pytest.mark.parametrize("name", ["p7_found", "p8_found"])
def test_text_is_not_shuffled(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert exchanges and not any(re.search(r"\btext#", columns) for columns in exchanges)
