import re

import pytest

from dokuma.llm import queries as q
from tests.oracle import FOLDER


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_no_join_of_all_pairs(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", q.queries()[name](spark, FOLDER)._jdf.queryExecution().toString())


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The tables in as many files as a large input has, so that nothing is spread by an exchange."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(16).write.parquet(f"{folder}/{name}.parquet")
    return folder


def exchanged(df):
    """The columns that go into each exchange of the plan."""
    sc = df.sparkSession.sparkContext
    text = sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) (?:Exchange|BroadcastExchange).*?\nInput \[\d+\]: \[(.*?)\]", text)


@pytest.mark.parametrize("name", ["p6_found", "p8_ids", "p9_found", "p10_found"])
def test_texts_are_not_shuffled(spark, many_files, name):
    if name == "p9_found":
        spark.read.parquet(f"{FOLDER}/benchmark_items.parquet").write.mode("overwrite").parquet(f"{many_files}/benchmark_items.parquet")
    assert not any("text#" in columns for columns in exchanged(q.queries()[name](spark, many_files)))


def test_exchanged_sees_texts(spark, many_files):
    docs = spark.read.parquet(f"{many_files}/documents.parquet").select("doc_id", "text").repartition(3)
    assert any("text#" in columns for columns in exchanged(docs))
