"""Every query with an oracle gives the oracle's rows at sf0.001; the others give rows."""

import datetime

import duckdb
import pytest

from loomgraph.queries import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_oracle(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(all_oracles()[name])
    names = [c[0] for c in result.description]
    assert columns == sorted(names)
    wanted = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_gives_rows(spark, sf, name):
    assert not all_queries()[name](spark, sf).isEmpty()
