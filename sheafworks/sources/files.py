"""Files in and out: corpora in a given order, inventories, pictures, parts, text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.functions.tables import fresh


def normal_path(path: str) -> str:
    """A path as a user gives it, as reported_path has it."""
    return re.sub("^file:/+", "/", path).rstrip("/") or "/"


def reported_path(path: Column) -> Column:
    """A path as Spark reports it, its escapes undone."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def read_corpus(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """All rows of the files (or folders of files) with input_order, the place of their path in the user's list.

    A path that is listed twice gives its rows twice, and so does a file in a folder that is listed too; Spark reads each
    of them once, and the join with the list multiplies them. Files meet the list by equality of the file or one of the
    folders above it. Patterns are no paths and an error.
    """
    given = [normal_path(p) for p in paths]
    if odd := [p for p in given if re.search(r"[*?{\[]", p)]:
        raise ValueError(f"patterns are not supported: {odd}")
    here, once = set(given), []
    for p in dict.fromkeys(given):
        above = ["/".join(p.split("/")[:k]) or "/" for k in range(1, p.count("/") + 1)]
        if not here.intersection(above):
            once.append(p)
    order = spark.createDataFrame(list(zip(given, range(len(given)), strict=True)), "given string, input_order int")
    rows = spark.read.format(fmt).load(once)
    path = fresh(rows, "path")
    rows = rows.withColumn(path, reported_path(F.col("_metadata.file_path")))
    parts = F.split(path, "/")
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    files = rows.select(path).distinct().select(path, F.explode(F.transform(places, lambda p: F.when(p == "", F.lit("/")).otherwise(p))).alias("given"))
    return rows.join(files.join(order, "given").drop("given"), path).drop(path)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, extension, length, modificationTime) of the files that match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return files.select("path", name.alias("name"), ext.alias("extension"), "length", "modificationTime")


RASTER = "origin string, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>"


#: Bytes of channel arrays that leave a task at once; a larger picture is a batch of its own.
PICTURE_BYTES = 16 << 20


def channels(size: int, n: int, data: pa.Buffer) -> list[pa.Array]:
    """Red, green, blue and alpha of one picture, whose bytes are blue, green, red (and alpha), or one grey."""
    raw = np.frombuffer(data, np.uint8).reshape(size, n)
    b, g, r = (raw[:, k] for k in range(3)) if n >= 3 else (raw[:, 0],) * 3
    a = raw[:, 3] if n == 4 else np.full(size, 255)
    return [pa.array(x.astype(np.int32)) for x in (r, g, b, a)]


def picture_batches(batches, limit: int | None = None):
    """Batches of decoded pictures; what is held is one batch under the limit, or one picture."""
    limit, kept, held = limit or PICTURE_BYTES, [], 0

    def batch():
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[3][k]) for x in kept)]).astype(np.int32)), pa.concat_arrays([x[3][k] for x in kept])) for k in range(4)]
        heads = [pa.array([x[k] for x in kept], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*heads, *lists], names=["origin", "width", "height", "r", "g", "b", "a"])

    for some in batches:
        for i in range(some.num_rows):
            origin, width, height, n = (some.column(k)[i].as_py() for k in range(4))
            size = 16 * width * height
            if kept and held + size > limit:
                yield batch()
                kept, held = [], 0
            kept.append((origin, width, height, channels(width * height, n, some.column(4)[i].as_buffer())))
            held += size
    if kept:
        yield batch()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures as channel arrays in row-major order; what can't be decoded is left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select("image.*").select("origin", "width", "height", "nChannels", "data").mapInArrow(picture_batches, RASTER)


def write_parts(df: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """One folder for each part_name. Small parts are one file; a large one is dealt to many tasks and files.

    Rows are rebalanced by part: adaptive execution joins small partitions and splits those above its advisory size. No
    file has more than rows_per_file rows.
    """
    df.hint("rebalance", "part_name").write.partitionBy("part_name").format(fmt).option("maxRecordsPerFile", rows_per_file).mode("overwrite").save(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("text").write.mode("overwrite").text(path)
