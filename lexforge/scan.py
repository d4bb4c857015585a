"""Running sums over groups of any size, a bounded number of rows in a task at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Neighbouring places that are summed in one task.
FAN = 4096


def same(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the named pairs of columns."""
    out = F.lit(True)
    for a, b in on:
        out &= left[a].eqNullSafe(right[b])
    return out


def before(df: DataFrame, keys: list[str], at: str, values: list[str], top: int, fan: int = FAN) -> DataFrame:
    """Adds ``before_<value>``: the sum of ``value`` over the rows of the same keys at smaller places.

    ``df`` has one row for each (keys, at), with ``at`` from 0 to ``top``.  No task sees
    more than ``fan`` places of a key: places are summed by ``fan``, these sums are
    scanned the same way, and each place adds what lies before it among its neighbours.
    Null keys are keys; an empty table gives an empty one.
    """
    fields = [F.col(k) for k in keys]
    if top < fan:
        w = W.partitionBy(*fields).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    up = f"{at}_block"
    block = F.floor(F.col(at) / fan).cast("long")
    sums = df.groupBy(*fields, block.alias(up)).agg(*[F.sum(v).alias(v) for v in values])
    coarse = before(sums, keys, up, values, top // fan, fan)
    coarse = coarse.select(*[F.col(k).alias(f"scan_{k}") for k in keys], F.col(up).alias("scan_at"), *[F.col(f"before_{v}").alias(f"scan_before_{v}") for v in values])
    rows = df.withColumn(up, block)
    w = W.partitionBy(*fields, up).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    out = rows.join(coarse, same(rows, coarse, [*((k, f"scan_{k}") for k in keys), (up, "scan_at")]))
    out = out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"scan_before_{v}") for v in values})
    return out.select(*df.columns, *[f"before_{v}" for v in values])
