"""Running sums and carried-forward values over an ordered log, without one task per game.

A plain ``partitionBy(game).orderBy(play)`` window hands a whole game to one
task. Here the window is partitioned by ``(game, block of plays)``; the carry
into each block comes from block totals, which are aggregated map-side and are
thousands of times smaller than the log. A game holding a third of all rows is
thereby spread over as many tasks as it has blocks, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlake import config as C

_BLOCK = "__block"


def block_of(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size))


BLOCK = "play_block"


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], order: str, size: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Inner join of a few rows per key to an ordered log, with the block as salt.

    A plain join on the key would put a whole game into one partition, and the
    windows after it would stay there. The per-key rows are repeated once per
    block that exists, so log and windows are both spread by (key, block). Adds
    the column ``play_block``. The hints keep the log, whose files are many times
    smaller than its rows, from being taken for small and sent through the driver.
    """
    blocked = df.withColumn(BLOCK, block_of(order, size))
    repeated = blocked.select(*keys, BLOCK).distinct().join(per_key.hint("merge"), keys)
    return blocked.join(repeated.hint("merge"), [*keys, BLOCK])


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    block: int | Column = C.PLAYS_PER_BLOCK,
) -> DataFrame:
    """Add running columns over ``order`` within ``keys``.

    ``sums``      running total up to and including the row;
    ``lasts``     last non-null value up to and including the row;
    ``previous``  last non-null value strictly before the row.
    ``order`` is unique within ``keys`` and ``block`` is a play count, or any
    column that never decreases along ``order``.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    block_col = block_of(order, block) if isinstance(block, int) else block
    held = {**{f"__s_{n}": c for n, c in sums.items()}, **{f"__l_{n}": c for n, c in {**lasts, **previous}.items()}}
    base = df.withColumns({_BLOCK: block_col, **held})

    within = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"__w_{n}": F.sum(f"__s_{n}").over(upto) for n in sums}
    local |= {f"__w_{n}": F.last(f"__l_{n}", ignorenulls=True).over(upto) for n in lasts}
    local |= {f"__w_{n}": F.last(f"__l_{n}", ignorenulls=True).over(before) for n in previous}
    rows = base.withColumns(local)

    totals = [F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums]
    totals += [
        F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), F.col(order))).alias(f"__t_{n}")
        for n in {**lasts, **previous}
    ]
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*keys, _BLOCK).agg(*totals).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_BLOCK).alias("__k_block"),
        *[F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in {**lasts, **previous}],
    )
    match = F.col(_BLOCK) == F.col("__k_block")
    for k in keys:
        match = match & (F.col(k) == F.col(f"__k_{k}"))
    joined = rows.join(carry.hint("merge"), match, "left")
    result = {n: F.coalesce(F.col(f"__w_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    result |= {n: F.coalesce(F.col(f"__w_{n}"), F.col(f"__c_{n}")) for n in {**lasts, **previous}}
    names = [c for c in df.columns if c not in result]
    return joined.select(*names, *[c.alias(n) for n, c in result.items()])
