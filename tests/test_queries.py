"""Every core query beside its SQL twin, on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from verify import norm  # noqa: E402

from gneiss.plans import evaluation, gate, grids, guard, guard_rules, records, retrieval  # noqa: E402

MODULES = (records, retrieval, grids, gate, evaluation, guard, guard_rules)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_entry_has_core_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
