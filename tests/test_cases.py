"""Hand-written rows through the library's functions and operators."""

import duckdb
import pytest

import cases_domain
import cases_runs  # noqa: F401  (it adds its cases)


def plain(v):
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(cases_domain.QUERIES))
def test_case(spark, name):
    got = cases_domain.QUERIES[name](spark, "")
    want = duckdb.sql(cases_domain.WANTED[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted([plain(r[c]) for c in sorted(got.columns)] for r in got.collect())
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted([plain(r[i]) for i in at] for r in want.fetchall())
