"""Helpers that keep plans safe when one image, region or component holds most rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# A side is only broadcast when it holds at most this many numbers (about 16 MB of doubles). The driver and every executor
# hold its rows with their pointers and hashed keys, which weigh as much as eight numbers more a row.
BROADCAST_CELLS = 2_000_000
ROW_CELLS = 8
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables (``spark.checkpoint.dir``)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fresh = tempfile.mkdtemp(prefix="spectrafold-")
    spark.sparkContext.setCheckpointDir(fresh)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the planner the true size of the table."""
    spark = df.sparkSession
    if getattr(df, "_written_once", False):
        return df
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_once = True
    return out


def _leaves(value: Column, kind: T.DataType) -> Column:
    """Number of scalar values inside a value, at least one; a string counts as many as its eight-byte words."""
    one = F.lit(1).cast("bigint")
    if isinstance(kind, T.StructType):
        total = F.lit(0).cast("bigint")
        for f in kind.fields:
            total = total + _leaves(value.getField(f.name), f.dataType)
        return F.greatest(total, one)
    if isinstance(kind, T.MapType):
        return _leaves(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType, T.StringType, T.BinaryType)):
            inner = F.aggregate(value, F.lit(0).cast("bigint"), lambda n, e: n + _leaves(e, kind.elementType))
        else:
            inner = F.size(value).cast("bigint")
        return F.greatest(F.coalesce(inner, one), one)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.greatest(F.coalesce(F.ceil(F.octet_length(value) / 8).cast("bigint"), one), one)
    return one


def _width(df: DataFrame) -> Column:
    width = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        width = width + _leaves(F.col(f"`{f.name}`"), f.dataType)
    return width


def cell_count(df: DataFrame) -> int:
    """Number of scalar cells of a table: everything inside nested arrays, maps and structs is counted."""
    return df.agg(F.sum(_width(df))).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    limit = BROADCAST_CELLS if limit is None else limit
    cells, rows = df.agg(F.sum(_width(df)), F.count(F.lit(1))).first()
    return (cells or 0) + ROW_CELLS * rows <= limit


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``salts`` tasks by replicating ``small``.

    Valid for inner, left, left_semi and left_anti joins with ``big`` on the left.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    spread = [c for c in big.columns if c in ("slice_id", "y", "x", "channel")] or list(big.columns)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def join_dim(big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner",
             limit: int | None = None) -> DataFrame:
    """Join a pixel-scale table to a table that is small in ordinary use.

    ``dim`` is often an aggregate of the big table itself, so it is written once rather than computed for
    the size check and again for the join. Below the limit it is broadcast, beyond it the join is salted.
    """
    dim = materialize(dim)
    if fits_broadcast(dim, limit):
        return big.join(F.broadcast(dim), list(on), how)
    return salted_join(big, dim, on, how)


join_stats = join_dim


def join_wide(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the pixels, always sorted and merged.

    The planner takes rows that an explode makes, or a well packed file, for a few bytes and would broadcast them.
    """
    return left.join(right.hint("merge"), list(on), how)


def clustered(df: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """The rows in ranges of ``keys``, each range sorted, so that a batch of a task holds few keys.

    ``spread`` cuts a key that outgrows a range; with n ranges at most n - 1 keys are cut.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys, *spread).sortWithinPartitions(*keys, *spread)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt out by ``keys`` for work in Python, over as many tasks as a shuffle has.

    The planner would merge tasks by their bytes, which say little of the time that a group takes in Python.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def theta_join(big: DataFrame, dim: DataFrame, on: Sequence[str], condition: Column,
               limit: int | None = None, salts: int = SALTS) -> DataFrame:
    """Range join on equal keys plus ``condition``: broadcast when measured small, else salted."""
    dim = materialize(dim)
    if fits_broadcast(dim, limit):
        joined = big.join(F.broadcast(dim), list(on), "inner")
    else:
        joined = salted_join(big, dim, on, "inner", salts)
    return joined.filter(condition)


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column,
                  name: str = "running", partitions: int | None = None) -> DataFrame:
    """Inclusive running sum inside each group, with the group spread over many tasks.

    Rows are range-partitioned by group and order and written once, so that the partition numbers
    stay fixed; each partition is summed by itself and shifted by the totals before it.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    placed = materialize(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
        .withColumn("_weight", weight)
    )
    totals = placed.groupBy(*group, "_part").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(g).alias(f"_key{i}") for i, g in enumerate(group)], F.col("_part").alias("_of"),
                          F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = (
        Window.partitionBy(*group, "_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.withColumn("_inside", F.sum("_weight").over(inside))
    same = F.col("_part") == F.col("_of")
    for i, g in enumerate(group):  # null keys are a group as well
        same = same & F.col(g).eqNullSafe(F.col(f"_key{i}"))
    return summed.join(shift, same).withColumn(name, F.col("_inside") + F.col("_shift")).select(*df.columns, name)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column | int,
          n_max: int, spread: Sequence[str] = ("y", "x"), salts: int = SALTS,
          rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group, exactly, without gathering a group in one task.

    Each group is cut into salts that keep their own first ``n`` rows. The survivors are ranked in
    one window when they are few, otherwise by a distributed running count.
    """
    n_col = n if isinstance(n, Column) else F.lit(n)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    kept = (
        df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(local))
        .filter(F.col("_rn") <= n_col).drop("_salt", "_rn")
    )
    if n_max * salts <= 1_000_000:
        ranked = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    else:
        ranked = running_total(kept, group, order, F.lit(1), rank).withColumn(rank, F.col(rank).cast("int"))
    return ranked.filter(F.col(rank) <= n_col)


def exact_percentile(df: DataFrame, group: Sequence[str], value: str, fractions: Sequence[float],
                     names: Sequence[str], distributed: bool = True) -> DataFrame:
    """Linearly interpolated percentiles per group.

    Equal values are counted first, so ties never travel; the distinct values are then ranked by a
    distributed running count and only the two order statistics around each fraction are kept.
    ``distributed=False`` uses the built-in aggregate and is meant for groups of bounded size.
    """
    if not distributed:
        aggs = [F.percentile(value, F.lit(float(p))).alias(n) for p, n in zip(fractions, names)]
        return df.groupBy(*group).agg(*aggs)
    if not group:
        one = exact_percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions, names)
        return one.drop("_all")
    freq = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(freq, group, [F.col(value)], F.col("_n"), "_upto")
    ranked = materialize(ranked)
    size = ranked.groupBy(*group).agg(F.max("_upto").alias("_size"))
    wanted = join_dim(ranked, size, group)
    first = F.col("_upto") - F.col("_n")  # zero-based rank of the first copy
    aggs = []
    for p, n in zip(fractions, names):
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda r: (r >= first) & (r < F.col("_upto"))
        aggs += [
            F.max(F.when(inside(lo), F.col(value))).alias(f"_{n}_lo"),
            F.max(F.when(inside(hi), F.col(value))).alias(f"_{n}_hi"),
        ]
    picked = wanted.groupBy(*group).agg(F.max("_size").alias("_size"), *aggs)
    out = []
    for p, n in zip(fractions, names):
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        part = pos - F.floor(pos)
        out.append((F.col(f"_{n}_lo") + part * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n))
    return picked.select(*group, *out)
