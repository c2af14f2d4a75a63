"""What the operators of this subpackage share: shared tables, packed arrays, tokenised blocks, exchanges, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, and the other white space to the blank; UTF-8's longer characters keep their bytes.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
#: White space that parts words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: Text of a block, and text that one partition of an exchange stands for.
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: A row's number is its task's, its block's within the task and its own within the block: 63 bits, for 134 million
#: tasks of a million blocks each. Beyond, numbering fails with an error; it never repeats a number.
ROW_BITS, BLOCK_BITS, TASK_BITS = 16, 20, 27
BLOCK_ROWS = 1 << ROW_BITS
#: Shorter arrays are not compressed.
SHORT = 64
DTYPES = ["|u1", "<u2", "<u4", "<u8", "|i1", "<i2", "<i4", "<i8", "<f4", "<f8", "|b1"]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's spark.checkpoint.dir. Only local mode, as in tests, does without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/sheaf-{uuid.uuid4().hex}"


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage is cut, lost executors cost nothing.

    Tables that a returned DataFrame reads must outlive the call; they lie in the sheaf-* folders of the session's
    spark.checkpoint.dir, which may be emptied when the results are written.
    """
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again, so that an operator's disk is that of its live tables."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stashed_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column_name: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column_name.replace("`", "``") + "`")


def _size(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes((n & 127 | 128,))
        n >>= 7
    return out + bytes((n,))


def _read_size(body: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while body[i] > 127:
        n |= (body[i] & 127) << shift
        shift += 7
        i += 1
    return n | body[i] << shift, i + 1


_zstd: dict[str, object] = {}


def pack(**arrays: np.ndarray) -> bytes:
    """Integer arrays in their narrowest type, bytes of one significance together, compressed.

    A message of one key and its count takes about 20 bytes, no more than a row of a plain table would.
    """
    squeeze = _zstd.get("c") or _zstd.setdefault("c", zstandard.ZstdCompressor(level=3))
    out = []
    for name, a in arrays.items():
        if a.dtype.kind in "iu" and len(a):
            low, high = int(a.min()), int(a.max())
            a = a.astype(np.min_scalar_type(high) if low >= 0 else np.min_scalar_type(min(low, -high - 1)), copy=False)
        wide = a.dtype.itemsize
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, wide).T).tobytes() if len(a) else b""
        small = squeeze.compress(raw) if len(raw) > SHORT else raw
        key = name.encode()
        out += [bytes((len(key),)), key, bytes((DTYPES.index(a.dtype.str) << 1 | (small is not raw),)), _size(len(a)), _size(len(small)), small]
    return b"".join(out)


def unpack(body: bytes) -> dict[str, np.ndarray]:
    spread = _zstd.get("d") or _zstd.setdefault("d", zstandard.ZstdDecompressor())
    out, i = {}, 0
    while i < len(body):
        k = i + 1 + body[i]
        name, code = body[i + 1 : k].decode(), body[k]
        n, i = _read_size(body, k + 1)
        size, i = _read_size(body, i)
        raw, kind = body[i : i + size], DTYPES[code >> 1]
        raw = np.frombuffer(spread.decompress(raw) if code & 1 else raw, np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)
        i += size
    return out


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The partitions of hashes of so many bits (33 at least): ranges of the hash, in the order of the keys."""
    return (((keys.astype(np.uint64) >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def runs_of(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values: only partitions that have keys are met, however many there are."""
    if not len(a):
        return []
    edge = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1, [len(a)]])
    return list(zip(a[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def trim(f):
    """f on one group, giving freed memory back to the system afterwards: workers are kept for later tasks."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted integer array; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def flat_text(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a column end to end, and each row's start and end; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None and at[-1] > at[0] else b""), at - at[0]


def words_of(texts: pa.Array, fold: bytes = FOLD) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows end to end (runs free of white space, folded), and how many each row has."""
    raw, at = flat_text(texts)
    raw = raw.translate(fold)
    lists = pc.split_pattern(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)), " ")
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(np.asarray(full.to_numpy(zero_copy_only=False), np.int64))])
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(full), np.diff(ends[edge])


def blocks(batches, limit: int = BLOCK_BYTES, text: str = "text", rows: int = BLOCK_ROWS):
    """Arrow batches regrouped to tables of some limit bytes of text and rows at most; a longer text is a block of its own."""
    kept, size, count = [], 0, 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for i, n in enumerate(lens.tolist()):
            if count and (size and size + n > limit or count == rows):
                kept.append(batch.slice(start, i - start))
                yield pa.Table.from_batches([b for b in kept if b.num_rows]).combine_chunks()
                kept, size, count, start = [], 0, 0, i
            size += n
            count += 1
        kept.append(batch.slice(start))
    kept = [b for b in kept if b.num_rows]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def block_id(k: int, task: int | None = None) -> int:
    """A number for the k-th block of this task; blocks are written to a table before they are used twice."""
    if task is None:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
    if k >> BLOCK_BITS or task >> TASK_BITS:
        raise OverflowError(f"block {k} of task {task} has no number")
    return (task << BLOCK_BITS) + k


def row_ids(block: int, n: int) -> np.ndarray:
    """Numbers of the rows of a block."""
    if n > BLOCK_ROWS:
        raise OverflowError(f"a block of {n} rows")
    return (np.int64(block) << ROW_BITS) + np.arange(n, dtype=np.int64)


def count_parts(table: DataFrame, column_name: str, each: float = PART_BYTES) -> int:
    """Partitions for an exchange: in proportion to all bytes, so that each keeps its size however large the input."""
    total = table.agg(F.sum(column_name)).first()[0] or 0
    return max(1, int(-(-total // each)))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each component, for all nodes that have an edge.

    Large-star and small-star steps by turns; each gives a written table. Minima are aggregated before they are
    shuffled, and joins of a hub's edges can be split by Spark.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = stash(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before, e_table = None, e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e_table, stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(last)
        e_table = e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
