import random

import pytest
from pyspark.sql import functions as F

from courtlake.functions.scans import running


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_running_equals_brute_force(spark, block):
    rng = random.Random(7)
    rows = [(g, n, rng.randint(0, 5), rng.choice([None, "a", "b", "c"])) for g in (1, 2) for n in range(40 if g == 1 else 3)]
    df = spark.createDataFrame(rows, "g int, n int, v int, s string").repartition(5)
    got = {(r.g, r.n): (r.total, r.seen, r.before) for r in running(
        df, ["g"], "n", sums={"total": F.col("v")}, lasts={"seen": F.col("s")}, previous={"before": F.col("s")}, block=block).collect()}
    for g in (1, 2):
        total, last = 0, None
        for _, n, v, s in sorted(r for r in rows if r[0] == g):
            before, total, last = last, total + v, s or last
            assert got[g, n] == (total, last, before)


def test_running_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5)], "g int, n int, v int")
    out = running(df, ["g"], "n", sums={"t": F.col("v")})
    assert out.columns == ["g", "n", "v", "t"] and sorted(r.t for r in out.collect()) == [0, 5]


@pytest.mark.parametrize("size", [2, 100])
def test_join_per_key_repeats_values_per_block(spark, size):
    from courtlake.functions.scans import BLOCK, join_per_key

    df = spark.createDataFrame([(g, n) for g in (1, 2, 3) for n in range(7)], "g int, n int")
    per = spark.createDataFrame([(1, "x"), (2, "y")], "g int, v string")
    out = join_per_key(df, per, ["g"], "n", size)
    assert sorted((r.g, r.n, r.v) for r in out.collect()) == [(g, n, v) for g, v in ((1, "x"), (2, "y")) for n in range(7)]
    assert out.select(BLOCK).distinct().count() == (4 if size == 2 else 1)
