"""Skew-safe per-key scans (running sums and 1-based ordinals).

A window ``partitionBy(key)`` sends all rows of a key to one task; a gene
that holds a third of all rows would make that one task a third of the job.
Here the order column is cut into blocks of ``block_rows``: block totals
are a partial aggregate, the offsets of blocks are a window over the small
per-key block table, and only rows of one (key, block) share a task.

Keys may be NULL (a NULL key is a group of its own).  The join back and
the in-block window use the same materialised, null-free key columns, so
the large side is shuffled once (or not at all when AQE broadcasts the
block table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_ROWS = 1 << 16


def _sentinel(dt: T.DataType):
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                       T.DecimalType)):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, T.DateType):
        return F.lit("1970-01-01").cast(dt)
    if isinstance(dt, T.TimestampType):
        return F.lit(0).cast("timestamp")
    return None


def _null_free_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Adds (value-or-sentinel, is-null) columns for each nullable key."""
    cols, added = [], []
    schema = {f.name: f for f in df.schema.fields}
    for i, k in enumerate(keys):
        f = schema[k]
        s = _sentinel(f.dataType)
        if not f.nullable or s is None:
            cols.append(k)
            continue
        v, n = f"_kv{i}", f"_kn{i}"
        df = df.withColumn(v, F.coalesce(F.col(k), s)).withColumn(n, F.col(k).isNull())
        cols += [v, n]
        added += [v, n]
    return df, cols, added


def exclusive_prefix_sum(df: DataFrame, keys: list[str], order_col: str, value_col: str,
                         out_col: str, block_rows: int = DEFAULT_BLOCK_ROWS,
                         total_col: str | None = None, after_join=None,
                         count_col: str | None = None, first_less: str | None = None) -> DataFrame:
    """Adds ``out_col`` = sum of ``value_col`` over earlier rows of the same key
    (ordered by ``order_col``, which must be unique within a key).  With
    ``total_col`` also adds the key's grand total.

    ``after_join(df) -> df`` may re-derive ``value_col`` on the second pass
    (it then sees ``total_col``); the first pass's value is not recomputed.
    Only rows whose re-derived value matters need it (others may use 0).
    ``count_col`` adds the number of rows of the key (from the same block table).
    ``first_less`` names a column by whose value the key's first row counts
    less; ``_first`` then tells which row that is (also to ``after_join``)."""
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_rows)).cast("bigint"))
    d, kc, added = _null_free_keys(d, keys)
    less = [F.min(F.struct(F.col(order_col).alias("at"), F.col(first_less).alias("less"))).alias("_lead")] if first_less else []
    blocks = d.groupBy(*kc, "_blk").agg(F.sum(value_col).alias("_bsum"), F.count(F.lit(1)).alias("_bcnt"), *less)
    wk = Window.partitionBy(*kc).orderBy("_blk")
    if first_less:
        # The key's first block leads: its first row is the key's, and its sum counts that row less.
        first = F.row_number().over(wk) == 1
        blocks = blocks.withColumn("_bsum", F.col("_bsum") - F.when(first, F.col("_lead.less")).otherwise(F.lit(0)))
        blocks = blocks.withColumn("_lead", F.first("_lead").over(wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        d = d.drop(first_less)
    offs = blocks.withColumn("_boff", F.coalesce(
        F.sum("_bsum").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total_col:
        offs = offs.withColumn(total_col, F.sum("_bsum").over(wk.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    if count_col:
        offs = offs.withColumn(count_col, F.sum("_bcnt").over(wk.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    offs = offs.drop("_bsum", "_bcnt")
    kb = kc + ["_blk"]
    j = (d if after_join is None else d.drop(value_col)).join(offs, kb)
    if first_less:
        j = j.withColumn("_first", F.col(order_col) == F.col("_lead.at")).drop("_lead")
    if after_join is not None:
        j = after_join(j)
    wb = Window.partitionBy(*kb).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = j.withColumn(out_col, (F.col("_boff") + F.coalesce(F.sum(value_col).over(wb), F.lit(0))))
    return out.drop("_blk", "_boff", *added)


def ordinal(df: DataFrame, keys: list[str], order_col: str, out_col: str = "idx",
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """1-based position of each row within its key, in ``order_col`` order."""
    d = df.withColumn("_one", F.lit(1).cast("bigint"))
    r = exclusive_prefix_sum(d, keys, order_col, "_one", "_before", block_rows)
    return r.withColumn(out_col, (F.col("_before") + 1).cast("bigint")).drop("_one", "_before")
