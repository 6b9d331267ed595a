"""Every query with a DuckDB statement, against that statement, on the smallest tables."""

import numpy as np
import pytest

from tests.conftest import DATA
from tessera.catalog import analysis, dedup, keyphrase, learning, lsh, recommend, relational, series, similarity, wiki
from tessera.catalog import queries as query_log

FAMILIES = (dedup, recommend, similarity, series, keyphrase, lsh, learning, query_log, wiki, relational, analysis)
SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Results of several hundred thousand rows even here; the catalogue compares them at sf0.01.
LARGE = {"random_indexing"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype == object:
            frame = frame.assign(**{c: frame[c].map(str)})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize(("family", "name"), [(f, n) for f in FAMILIES for n in f.ORACLE if n not in LARGE], ids=lambda x: x if isinstance(x, str) else "")
def test_statement(spark, duck, family, name):
    got = canonical(family.QUERIES[name](spark, str(SF)).toPandas())
    want = canonical(duck.sql(family.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=2e-6, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_every_statement_has_a_query():
    for f in FAMILIES:
        assert set(f.ORACLE) <= set(f.QUERIES)
