"""Every query with SQL gives the rows that DuckDB gives for it over the same tables."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    """A value by which rows of the two engines can be compared."""
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (datetime, date)):
        return str(x).replace("+00:00", "")
    return float(x) if isinstance(x, int) and abs(x) < 2**53 else x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in (row.asDict(recursive=True) for row in df.collect()))
    result = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"M6_greedy_links_M1_tier3", "M1_ladder", "M1_ladder_outcomes_M10", "M11_member_mapping", "T6w_settle_writes"}
