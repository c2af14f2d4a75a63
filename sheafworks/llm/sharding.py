"""Sharding by sampled splitters: size-weighted key samples, quantile ranges, overfull ranges subdivided.

Law `bytes`: the shards' sizes differ by less than twice the largest record. Records are laid out along ranges of the
text's hash, so that equal texts are neighbours and mostly share a shard; a run of copies larger than a shard is cut.

The splitters are a bounded number, whatever the input. A range that holds more rows than a task should have is cut at
equal steps of its keys, and what is still too full (copies of one text) by row. Only the sampled keys and a row of
totals for each range reach the driver, RANGES of them at most; all below is counted in tables.

Defined cases: a null text has size 1 and the checksum of no bytes; a null id sorts first; equal rows get slots of
their own, whichever; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafworks.llm.common import documents, named, stash

#: Rows that one task should sort, most ranges, least number of ranges for each shard, sampled keys for each range.
ROWS, RANGES, RANGES_PER_SHARD, SAMPLES = 100_000, 4096, 4, 24


def looked_up(table: np.ndarray):
    """Column function: table[i], for a table of bounded size."""

    @F.pandas_udf("long")
    def at(i: pd.Series) -> pd.Series:
        return pd.Series(table[i.to_numpy(np.int64)])

    return at


def draw_splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantiles of keys drawn with a chance in proportion to their size: about SAMPLES * ranges, whatever the input."""
    draw = F.pmod(F.xxhash64("row", "key", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(draw < F.col("size") * F.lit(SAMPLES * ranges / max(1, total))).select("key").toPandas()["key"].to_numpy(np.int64)
    drawn.sort()
    return np.unique(drawn[np.linspace(0, len(drawn), ranges, endpoint=False).astype(int)[1:]]) if len(drawn) else drawn


def assign(records: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", rows_per_unit: int = ROWS, most_ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each record."""
    body = F.coalesce(named(text), F.lit(""))
    rows = stash(records.select(F.monotonically_increasing_id().alias("row"), named(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("key")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters = draw_splitters(rows, total, min(most_ranges, max(shards * RANGES_PER_SHARD, -(-n // rows_per_unit))))

    @F.pandas_udf("long")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right"))

    ranged = rows.withColumn("range", range_of("key"))
    full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("range")
    at = full["range"].to_numpy(np.int64)
    of_range = lambda values: looked_up(spread(at, values, len(splitters) + 1))
    low, high = full["low"].to_numpy(np.int64), full["high"].to_numpy(np.int64)
    steps = np.maximum(1, -(-full["n"].to_numpy(np.int64) // rows_per_unit))
    bytes_before, rows_before = (np.cumsum(full[c].to_numpy(np.int64)) - full[c].to_numpy(np.int64) for c in ("bytes", "n"))

    # the place of a key within its range, in so many equal steps
    wide = (F.col("key").cast("double") - of_range(low)("range")) / (of_range(high)("range").cast("double") - of_range(low)("range") + 1.0)
    cells = ranged.withColumn("cell", F.greatest(F.lit(0), F.least(of_range(steps)("range") - 1, F.floor(wide * of_range(steps)("range")))).cast("int"))
    overfull = cells.groupBy("range", "cell").agg(F.count("*").alias("c")).where(F.col("c") > 2 * rows_per_unit).select(F.col("range").alias("r"), F.col("cell").alias("k"), F.ceil(F.col("c") / rows_per_unit).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int")
    units = stash(cells.join(overfull, (F.col("range") == F.col("r")) & (F.col("cell") == F.col("k")), "left").withColumn("piece", piece).drop("r", "k", "pieces"))

    unit = ["range", "cell", "piece"]
    earlier = Window.partitionBy("range").orderBy("cell", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = units.groupBy(*unit).agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    before = lambda name, c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name)
    sums = sums.select(*unit, before("unit_bytes", "b"), before("unit_rows", "c"))
    w = Window.partitionBy(*unit).orderBy("key", "doc_id", "text_crc32", "row")
    placed = units.withColumn("run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w)).join(sums, unit)
    placed = placed.withColumn("middle", 2 * (of_range(bytes_before)("range") + F.col("unit_bytes") + F.col("run")) - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(2 * max(1, total))).cast("int"))
    placed = stash(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (of_range(rows_before)("range") + F.col("unit_rows") + F.col("nth") - 1).alias("place")))
    starts = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}  # a row for each shard
    begin = F.array(*[F.lit(int(starts.get(k, 0))).cast("long") for k in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.get(begin, F.col("shard"))).alias("slot"))


def spread(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[at] = values
    return out


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sampled_splitters": op6_sampled_splitters}
ORACLES: dict[str, str] = {}
