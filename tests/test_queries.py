"""Every registered query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest

from wayfold.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return repr(0.0 if v == 0 else float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        few = sorted(map(str, QUERIES["pair_topk_choice"](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == sorted(map(str, QUERIES["pair_topk_choice"](spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_origin_has_its_column(spark):
    moves = QUERIES["population_transitions"](spark, SF).collect()
    matrix = QUERIES["transition_matrix_all"](spark, SF).collect()
    assert {(c, m.to_activity): m[c] for m in matrix for c in m.asDict() if c != "to_activity" and m[c]} == {(m.from_activity, m.to_activity): m.prob for m in moves}
