"""The queries that scan all documents or vectors against their twins in SQL."""

import pytest
from compare import plain

from prismlake.llm import queries


@pytest.mark.parametrize("name", ["op11_suffix_arrays", "op12_word_runs", "op13_heap_lloyd"])
def test_against_sql(name, spark, duck, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain(want.fetchall())
