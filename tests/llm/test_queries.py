import pytest

from dokuma.llm import queries as q
from tests.oracle import FOLDER, connect, same

CON = connect()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, name):
    same(q.queries()[name](spark, FOLDER), CON, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    q.queries()[name](spark, FOLDER).collect()


def test_columns_of_found(spark):
    want = {
        "p1_found": ["example_id", "defect_type"], "p2_found": ["item_kind", "item_id"], "p3_found": ["kept_id", "copy_id"], "p4_found": ["token", "token_type", "mark"], "p5_found": ["source"],
        "p6_found": ["doc_id", "kind"], "p7_found": ["doc_id_a", "doc_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "level"],
    }
    for name, cols in want.items():
        assert q.queries()[name](spark, FOLDER).columns == cols
