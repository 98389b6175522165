"""The bitmap queries on keys beyond the sizes that bitmaps once had in them, against their SQL."""

import duckdb

from gristmill.plans import sketch_queries

BIG = 1 << 40


def put(spark, d, name, columns, rows):
    spark.createDataFrame(rows, columns).write.parquet(f"{d}/{name}.parquet")


def suppliers(spark, d, a, r):
    put(spark, d, "lineitem", "l_suppkey long, l_returnflag string", [(k, "A") for k in a] + [(k, "R") for k in r] + [(8, "N")])


def same_as_sql(spark, d, name):
    """The sorted rows of a query, which must be those of its SQL."""
    con = duckdb.connect()
    for t in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    got = sorted(tuple(r) for r in sketch_queries.QUERIES[name](spark, str(d)).collect())
    assert got == sorted(con.execute(sketch_queries.ORACLE[name]).fetchall())
    return got


def test_complement(spark, tmp_path):
    suppliers(spark, tmp_path, [0, 7, 7, 4095, 4096, BIG], [3])
    got = same_as_sql(spark, tmp_path, "bitmap_complement")
    assert len(got) == 4093 and (1,) in got and (4095,) not in got


def test_contains(spark, tmp_path):
    for name, asked, found in (("in", [15, 4096, BIG], True), ("out", [15, 5000], False)):
        d = tmp_path / name
        suppliers(spark, d, [1, 15, 4096, BIG], [5000])
        put(spark, d, "supplier", "s_suppkey long", [(k,) for k in asked])
        assert same_as_sql(spark, d, "bitmap_contains") == [(found,)]


def test_delete(spark, tmp_path):
    suppliers(spark, tmp_path, [1, 15, 4095, 4096, BIG], [15, 4096, 5000])
    assert same_as_sql(spark, tmp_path, "bitmap_delete") == [(1,), (4095,), (BIG,)]


def test_equals(spark, tmp_path):
    for name, r, equal in (("same", [BIG, 4096, 15, 15], True), ("other", [15, 4096, BIG + 1], False)):
        suppliers(spark, tmp_path / name, [15, 4096, BIG], r)
        assert same_as_sql(spark, tmp_path / name, "bitmap_equals") == [(equal,)]


def test_intersect(spark, tmp_path):
    suppliers(spark, tmp_path, [1, 15, 4096, BIG, BIG + 1], [15, 4096, 5000, BIG])
    assert same_as_sql(spark, tmp_path, "bitmap_intersect") == [(15,), (4096,), (BIG,)]


def test_range(spark, tmp_path):
    suppliers(spark, tmp_path, [0, 15, 299, 4096, BIG], [3])
    got = same_as_sql(spark, tmp_path, "bitmap_range")
    assert len(got) == 291 and {(0,), (4096,), (BIG,)} <= set(got) and (15,) not in got


def test_union(spark, tmp_path):
    suppliers(spark, tmp_path, [1, 4096, BIG], [1, 5000, BIG, BIG + 1])
    assert same_as_sql(spark, tmp_path, "bitmap_union") == [(1,), (4096,), (5000,), (BIG,), (BIG + 1,)]


def test_xor(spark, tmp_path):
    put(spark, tmp_path, "customer", "c_custkey long, c_acctbal double", [(2, -1.0), (65536, -1.0), (BIG, -5.0), (70000, -2.0), (9, 3.0)])
    put(spark, tmp_path, "orders", "o_custkey long, o_orderstatus string", [(2, "F"), (BIG, "F"), (BIG, "F"), (80000, "F"), (70000, "O")])
    assert same_as_sql(spark, tmp_path, "bitmap_xor") == [(65536,), (70000,), (80000,)]
