"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest
from pandas import isna

from docloom.operators import entities
from docloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or not isinstance(value, (str, list)) and isna(value):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value).removesuffix(" 00:00:00")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(float(v) if type(v).__module__ == "numpy" and "float" in type(v).__name__ else v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entity_members(spark):
    sets = {1: "ab", 2: "ab", 3: "abc", 4: "cd", 5: "ab", 6: "a", 7: "cd", 8: "xy"}
    table = spark.createDataFrame([(i, e) for i, es in sets.items() for e in es], "doc_id long, entity string")
    linked = {i: sum(j != i and len(set(es) & set(other)) >= 2 for j, other in sets.items()) for i, es in sets.items()}
    got = {r.doc_id: (r.representative, r.links) for r in entities.members(table, 2).collect()}
    assert got == {i: (min(j for j in sets if sets[j] == es), linked[i]) for i, es in sets.items() if len(es) >= 2}
