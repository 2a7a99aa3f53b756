import pytest
from docwright import llm

from ..oracle import agree


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_agrees_with_sql(spark, data, name):
    agree(spark, data, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, data, name):
    df = llm.queries()[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2] / "docwright"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p
