"""Every query of the library against its SQL on the smallest tables."""

import pytest

from textloom import catalog


#: Queries that SQL can't say, and the tests that hold them against brute force.
TESTED = {
    "fnv_simhash": "test_operators.py",
    "sip_simhash": "test_neardup.py",
    "neardup_pairs": "test_neardup.py",
    "window_dedup": "test_neardup.py",
    "unique_lines": "test_neardup.py",
    "code_filter": "test_operators.py",
    "json_crush": "test_operators.py",
    "json_schema_view": "test_operators.py",
    "json_field_sketches": "test_json_arrays.py",
}


def test_every_query_is_checked():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(TESTED)


def cell(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(cols).collect()), key=repr)
    if name not in catalog.ORACLES:
        return
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(cell(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
