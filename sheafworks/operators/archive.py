"""Catalogs and reports: search, categories, archive manifests, delta decoding, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafworks.functions.tables import fresh, half_up, running_total

LOCAL, CENTRAL = 30, 46


def search_catalog(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    """Rows with q in any of cols, whatever the case; a blank q returns all."""
    q = q.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return df.where(hit)


def category_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("n_ready"), F.count_if(F.col("status") != "ready").alias("n_planned"))


def compress_report(sizes: DataFrame) -> DataFrame:
    """Pictures replaced (smaller, or of another width), bytes before and after, percent saved. sizes: new_width too."""
    hit = sizes.where((F.col("size_after") < F.col("size_before")) | (F.col("new_width") != F.col("width")))
    out = hit.agg(F.count("*").alias("touched"), F.coalesce(F.sum("size_before"), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("size_after"), F.lit(0)).alias("bytes_after"))
    saved = half_up(F.lit(100.0) * (F.lit(1.0) - F.col("bytes_after") / F.col("bytes_before")))
    return out.withColumn("percent_saved", F.when(F.col("bytes_before") > 0, saved).otherwise(0).cast("long"))


def archive_manifest(entries: DataFrame) -> DataFrame:
    """Per entry: method (8, or 0 where deflating doesn't help), payload, offset of its header, size of its catalog
    record; crc32 where the data are at hand. Offsets are sums over runs of entries, so that a giant archive is spread."""
    stored = F.col("compressed_size") >= F.col("size")
    e = entries.withColumn("method", F.when(stored, 0).otherwise(8)).withColumn("payload", F.when(stored, F.col("size")).otherwise(F.col("compressed_size")))
    if "data" in entries.columns:
        e = e.withColumn("crc", F.crc32("data")).drop("data")
    size = F.lit(LOCAL) + F.octet_length("name") + F.col("payload")
    out = running_total(e, ["archive"], "entry_no", size, "offset")
    return out.withColumn("central_size", F.lit(CENTRAL) + F.octet_length("name"))


def icon_directory(icons: DataFrame) -> DataFrame:
    """Offsets of the pictures in an icon file: 6 + 16 n bytes of directory come first. icons: (archive, entry_no, size)."""
    n, before = fresh(icons, "n", "before")
    counts = icons.groupBy("archive").agg(F.count("*").alias(n))
    out = running_total(icons, ["archive"], "entry_no", F.col("size"), before).join(counts, "archive")
    return out.withColumn("offset", F.lit(6) + 16 * F.col(n) + F.col(before)).drop(n, before)


def delta_decode(samples: DataFrame) -> DataFrame:
    """Adds value: running sum of the deltas of a row, modulo 256. samples: (row_id, pos, delta)."""
    before = fresh(samples, "before")
    out = running_total(samples, ["row_id"], "pos", F.col("delta"), before)
    return out.withColumn("value", F.pmod(F.col(before) + F.col("delta"), F.lit(256)).cast("int")).drop(before)
