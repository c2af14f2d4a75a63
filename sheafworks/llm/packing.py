"""Variable-capacity best-fit packing of documents into training sequences.

A document longer than the largest capacity is cut: its full pieces fill bins of their own, the rest is packed. Pieces
are dealt by hash to shards of bounded size; each shard packs its pieces in decreasing length into the open bin with
the least room that still holds them. Where none does, the bin size is opened whose cost, less the worth of the room
it leaves, is least. How much of that room will be used is not known beforehand, so that several expectations are
tried and the cheapest outcome is kept. At the end each bin is downsized to the smallest capacity that holds its
contents, which is why the capacities are weighed jointly: a bin is opened large only for what may follow.

A shard's loss against one large packing is at most a part-filled bin or so for each capacity.

`pack_documents` plans from lengths alone; `sequences` takes each document's tokens (ids, or anything else in an array)
through the same packing and gives the filled sequences. Full pieces of long documents are sequences of their own and go
through no shard.

Defined cases: a null or blank text has the end token only; null and empty token lists are packed nowhere; null and
repeated ids are packed row by row; ties in length go by id; columns other than those named play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.llm.common import column, documents, named, stash

#: Production parameters: permitted lengths, cost of a sequence beside its tokens, pieces in a shard.
CAPACITIES, OVERHEAD, SHARD = (512, 1024, 2048, 4096, 8192), 64, 10_000
USES = (0.0, 0.5, 0.8, 0.95)
RESULT = "doc_id long, piece long, start long, n_tokens long, bin_id long, capacity int, offset long, bin_tokens long"
BINS = "bin_id long, capacity int, n_tokens long, doc_ids array<long>, starts array<long>, offsets array<long>"


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int, use: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece (decreasing lengths), offset in it, and contents of the bins."""
    unit = min((c + overhead) / c for c in capacities)
    opens: dict[int, int] = {}
    room: dict[int, list[int]] = {}  # bins by room left
    some, fill = 0, []  # bit r of some: a bin has room r
    bins, offsets, size = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for k, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            left = (fits & -fits).bit_length() - 1 + n
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            if n not in opens:
                opens[n] = min((c for c in capacities if c >= n), key=lambda c: (c + overhead - use * unit * (c - n), c))
            b, left = len(fill), opens[n]
            fill.append(0)
            size.append(left)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += n
        left -= n
        if left:
            room.setdefault(left, []).append(b)
            some |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def downsized(fill: np.ndarray, capacities: tuple[int, ...]) -> np.ndarray:
    return np.array(capacities)[np.searchsorted(capacities, fill)]


def cheapest(lengths: np.ndarray, capacities: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the outcomes of all expectations that of least cost: bins, offsets, contents."""
    return min((best_fit(lengths, capacities, overhead, use) for use in USES), key=lambda x: cost(x[2], capacities, overhead))


def cost(fill: np.ndarray, capacities: tuple[int, ...], overhead: int) -> int:
    return int((downsized(fill, capacities) + overhead).sum())


def pack_shard(capacities: tuple[int, ...], overhead: int, whole: bool, mark: str | None = None):
    """Pieces of one shard to their places; with whole, to sequences. mark: what parts tokens that come as one string."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        n = t.column("n_tokens").to_numpy()
        bins, offsets, fill = cheapest(n, capacities, overhead)
        size, first = downsized(fill, capacities).astype(np.int32), (t.column("shard")[0].as_py() + 1) << 32
        if not whole:
            return t.select(["doc_id", "piece", "start", "n_tokens"]).append_column("bin_id", pa.array(first + bins)).append_column("capacity", pa.array(size[bins])).append_column("offset", pa.array(offsets)).append_column("bin_tokens", pa.array(fill[bins]))
        order = np.lexsort((offsets, bins))
        t, edge = t.take(pa.array(order)), np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=len(fill)))]).astype(np.int32)
        lists = lambda a, at: pa.ListArray.from_arrays(pa.array(at), a)
        tokens = column(t, "tokens") if mark is None else pc.split_pattern(column(t, "tokens"), mark).cast(pa.list_(pa.string()))
        tokens = pc.list_flatten(tokens)
        return pa.table({
            "bin_id": pa.array(first + np.arange(len(fill))), "capacity": size, "n_tokens": fill, "doc_ids": lists(column(t, "doc_id"), edge), "starts": lists(column(t, "start"), edge),
            "offsets": lists(pa.array(offsets[order]), edge), "tokens": lists(tokens, np.concatenate([[0], np.cumsum(fill)]).astype(np.int32)),
        })

    return pack


def cut_pieces(docs: DataFrame, n: Column, most: int, *more: Column) -> DataFrame:
    """(doc_id, salt, row, piece, start, n_tokens, more): a document's tokens in pieces of the largest capacity, the last shorter."""
    pieces = docs.select("doc_id", "salt", F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n"), *more)
    pieces = pieces.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece"))
    return pieces.withColumn("start", F.col("piece") * most).withColumn("n_tokens", F.least(F.lit(most), F.col("n") - F.col("start")).cast("long")).drop("n")


def dealt(pieces: DataFrame, shards: int) -> DataFrame:
    """Pieces with their shard. The row's number is part of the hash, so that equal rows are spread as well."""
    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "salt", "piece", "n_tokens", "row"), F.lit(shards)).cast("long")).drop("salt", "row")


def full_ids(docs: DataFrame) -> DataFrame:
    """bin_id of bins that one full piece fills: below those of all shards."""
    return docs.withColumn("bin_id", -1 - F.monotonically_increasing_id())


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text", n_tokens: Column | None = None) -> DataFrame:
    """A row for each piece of a document: tokens start..start+n_tokens lie at offset of bin_id.

    Tokens are words and an end, or as many as n_tokens says."""
    most = max(capacities)
    words = F.regexp_count(F.coalesce(named(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(named(text)).alias("salt"), (words if n_tokens is None else n_tokens).alias("count"))
    pieces = stash(cut_pieces(source, F.col("count"), most))
    full, rest = pieces.where(F.col("n_tokens") == most), pieces.where(F.col("n_tokens") < most)
    shards = max(1, -(-rest.count() // shard))
    packed = dealt(rest, shards).groupBy("shard").applyInArrow(pack_shard(tuple(sorted(capacities)), overhead, False), RESULT)
    whole = full_ids(full).select("doc_id", "piece", "start", "n_tokens", "bin_id", F.lit(most).alias("capacity"), F.lit(0).cast("long").alias("offset"), F.col("n_tokens").alias("bin_tokens"))
    return packed.unionByName(whole)


def sequences(docs: DataFrame, tokens: str = "ids", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, doc_id: str = "doc_id", mark: str | None = None) -> DataFrame:
    """A row for each sequence: its tokens end to end, and whose they are: doc_ids, starts in the documents, offsets here.

    Where tokens are strings and none holds `mark` (nor is empty), pieces are moved as one string each, in less space."""
    most, kind = max(capacities), docs.schema[tokens].dataType
    sizes = docs.select(F.greatest(F.size(named(tokens)), F.lit(0)).alias("n"))
    shards = max(1, -(-int(sizes.agg(F.count_if((F.col("n") > 0) & (F.col("n") % most > 0))).first()[0]) // shard))
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(named(tokens)).alias("salt"), named(tokens).alias("all"))
    pieces = cut_pieces(source, F.greatest(F.size("all"), F.lit(0)), most, F.col("all")).withColumn("tokens", F.slice("all", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))).drop("all")
    # Arrow lists may hold nulls, whatever the column of the input may
    schema = T.StructType([*T.DataType.fromDDL(BINS).fields, T.StructField("tokens", T.ArrayType(kind.elementType))])
    short = dealt(pieces.where(F.col("n_tokens") < most), shards)
    short = short if mark is None else short.withColumn("tokens", F.array_join("tokens", mark))
    packed = short.groupBy("shard").applyInArrow(pack_shard(tuple(sorted(capacities)), overhead, True, mark), schema)
    zero = F.array(F.lit(0).cast("long"))
    whole = full_ids(pieces.where(F.col("n_tokens") == most)).select("bin_id", F.lit(most).alias("capacity"), "n_tokens", F.array("doc_id").alias("doc_ids"), F.array("start").alias("starts"), zero.alias("offsets"), "tokens")
    return packed.unionByName(whole)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op2_best_fit": op2_best_fit}
ORACLES: dict[str, str] = {}
