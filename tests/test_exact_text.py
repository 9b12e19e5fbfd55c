"""Decimal text of doubles, rounded as C does, and the query that prints it."""

import random
import struct

import duckdb

from stridewell.catalog import ORACLES, QUERIES
from stridewell.functions import rational


def test_text_of_doubles(spark):
    rng = random.Random(5)
    xs = [0.0, -0.0, 0.5e-12, 1.5e-12, 1e-300, 5e-324, 0.9999999999995, 0.9999999999994999, 4503.1, 1000000.1, 2.0**53 - 0.5, 9e18, -1 / 8192, None]
    xs += [k / 8192 for k in range(40)] + [k / 40960 for k in range(40)] + [k + 0.5 / 10**12 for k in range(9)]
    xs += [rng.randrange(1 << 40) / 10**12 + rng.choice([0.5e-12, -0.5e-12, 0]) for _ in range(400)]
    xs += [struct.unpack("d", struct.pack("Q", (rng.randrange(960, 1080) << 52) | rng.getrandbits(52)))[0] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, v double")
    got = dict(rational.with_text(df, "v", "t").select("i", "t").collect())
    assert got == {i: None if x is None else f"{x:.12f}" for i, x in enumerate(xs)}


def test_q87_at_ties_and_odd_quantities(spark, tmp_path):
    """Denominators of 16,384 and 40,960 reach ties of the thirteenth digit."""
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    quantities = [*map(float, range(52)), 2.5, 3.5, None, 1e9]
    rows = [(s, n, s * n, s, q) for s in (0, 1, 1365, 5461, 13653, 59999) for n, q in enumerate(quantities)]
    rows.append((7, 0, 1, None, 3.0))
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    names = ["l_orderkey", "l_linenumber", "l_partkey", "micros", "within_tick", "decimal_text"]
    got = QUERIES["q87_exact_arithmetic"](spark, str(tmp_path)).select(*names).collect()
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['q87_exact_arithmetic']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
