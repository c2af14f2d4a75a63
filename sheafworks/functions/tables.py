"""Small helpers on tables that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared checkpoint folder and read again: loops keep no lineage, lost executors cost nothing."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote and nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame | list[DataFrame], *names: str) -> str | list[str]:
    """The names, each with as many underscores before it as make it unlike all columns of the tables."""
    taken = {c.lower() for t in (df if isinstance(df, list) else [df]) for c in t.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out[0] if len(out) == 1 else out


def half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def totals(rows: DataFrame, keys: list[str], run: str, order: list[str], value: Column, before: str, whole: str | None = None) -> DataFrame:
    """rows with the sum of value over the rows before by key and order, and over all rows of the key. Runs follow the order.

    Two levels: sums within runs, and runs before them, so that one giant key is no single task.
    """
    v, inside, total, earlier, *on = fresh(rows, "v", "inside", "total", "earlier", *[f"{k}_of" for k in [*keys, run]])
    rows_v = rows.withColumn(v, value)
    sums = rows_v.groupBy(*[F.col(k).alias(o) for k, o in zip([*keys, run], on, strict=True)]).agg(F.sum(v).alias(total))
    of_key = Window.partitionBy(*on[:-1])
    sums = sums.withColumn(earlier, F.coalesce(F.sum(total).over(of_key.orderBy(on[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn(total, F.sum(total).over(of_key)) if whole else sums.drop(total)
    inner = Window.partitionBy(*keys, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows_v.withColumn(inside, F.coalesce(F.sum(v).over(inner), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip([*keys, run], on, strict=True)]
    out = out.join(sums, match).withColumn(before, F.col(inside) + F.col(earlier))
    return out.select(*[F.col(c) for c in rows.columns], before, *([F.col(total).alias(whole)] if whole else []))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 100_000) -> DataFrame:
    """Adds the sum of value over the rows before, by key and a whole-number order. Runs are width orders."""
    run = fresh(df, "run")
    return totals(df.withColumn(run, F.floor(F.col(order) / width)), keys, run, [order], value, name).drop(run)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, whole: str | None = None, width: int = 100_000) -> DataFrame:
    """Adds name, 1..N by key and order, and whole, the N of the key.

    One whole-number column is cut to runs of width numbers. Any other order is cut by range partitions: rows are dealt by
    ranges of keys and order, written with their partition's number, and numbered within it.
    """
    run = fresh([df], "run", name)[0]
    kind = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(kind, IntegralType):
        rows = df.withColumn(run, F.floor(F.col(order[0]) / width))
    else:
        rows = cut(df.repartitionByRange(*keys, *order).withColumn(run, F.spark_partition_id()))
    out = totals(rows, keys, run, order, F.lit(1).cast("long"), name, whole)
    return out.withColumn(name, F.col(name) + 1).drop(run)
