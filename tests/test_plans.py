"""Physical plans: no joins of all pairs, and scans that read only what a query needs."""

import re

import pytest

from dokuma.plans import registry
from tests.oracle import FOLDER

#: Queries that join single rows.
ONE_ROW = {"encode_meta", "run_meta"}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - ONE_ROW))
def test_no_join_of_all_pairs(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.queries()[name](spark, FOLDER)))


def test_scans_are_pruned_and_filtered(spark):
    text = plan(registry.queries()["tokenize"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(registry.queries()["suffix_labels"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[IsNotNull\(token_type\)\]", text) and "ReadSchema: struct<token:string,token_type:string>" in text
