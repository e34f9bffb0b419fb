import pytest

pytest.importorskip("loomspan.llm.queries")
from oracle import check, rows

from loomspan.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    if name in queries.ORACLE:
        check(spark, data, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert rows(queries.QUERIES[name](spark, data))[1]


def test_found_by_operator(spark, data):
    forms = queries.p1_forms(spark, data)
    assert {r["id"] for r in queries.p1_found(spark, data).collect()} <= {r["id"] for r in forms.where("quote_form = verbatim_form").collect()}
    assert queries.p8_round_trip(spark, data).where("documents <> exact").count() == 0
    spans = queries.p10_found(spark, data)
    assert spans.where("char_start >= char_end").count() == 0
