"""Centroid clustering (Lloyd's rounds, exact in integers) over Hilbert-ordered blocks with zone maps.

Vectors become integers floor(scale * x). They are ordered along a Hilbert curve through the axes of most variance and cut
into blocks of at most TILE; each block keeps its vectors and its zone map, the least and greatest value of each component.
A round broadcasts the centroids (k vectors, a parameter). A block compares the zone map with all centroids: no vector in
the box is nearer to a centroid than the box is, and all are within the farthest corner of the best one, so that only
centroids whose near bound is not beyond the least far bound are candidates. Its vectors are compared with those, exactly.
A task adds up its clusters' components; sums of tasks are added in Spark, and k sums reach the driver.

The curve, its axes and its steps change how many candidates a block has, never the result.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones are left out, and
so are those whose integers lie beyond 2 ** 27, for which squared distances would not fit a long; each row counts as a
vector and gets a row; a null id is hashed as the empty string; rows that tie for a start (repeated ids) are taken by their
components; with fewer than k vectors there are as many centroids as vectors; other columns, whatever their names, play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.llm.common import column, documents, named, pack, stash, unpack

#: Length of the vectors, integer steps of 1.0, centroids, rounds, seed of the first centroids.
PARAMS = {"dims": 64, "scale": 256, "k": 40, "rounds": 5, "seed": 2}
#: Vectors of a block; axes of the curve, and binary digits of each: 60 bits of key.
TILE, AXES, DIGITS = 512, 12, 5
LIMIT = 1 << 27
#: Integers up to this give squared distances of at most 2 ** 53 with up to 128 components, exact as doubles.
SMALL = 1 << 21


def hilbert(x: np.ndarray, digits: int) -> np.ndarray:
    """Places on a Hilbert curve of rows of numbers of so many digits (Skilling's transposition, all rows at once)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(digits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = x[:, i] >> level & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(digits - 1, 0, -1):
        flip ^= np.where(x[:, n - 1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(digits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> level & 1
    return key


def matrix(a: pa.Array, dims: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def integers(vectors: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    scaled = F.transform(F.col("x"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    out = vectors.select(named(vec_id).alias("id"), named(vector).alias("x")).where(F.size("x") == dims)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale >= LIMIT)
    return out.where(~F.exists("x", bad)).select("id", scaled.alias("v"))


def curve_axes(v: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The axes of most variance, and where the middle of their values begins and ends (two deviations each way)."""

    def moments(batches):
        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(total), pa.array(square)], names=["axis", "n", "total", "square"])

    rows = v.select("v").mapInArrow(moments, "axis int, n long, total double, square double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square")).collect()
    n, total, square = (np.array([r[c] for r in sorted(rows)], np.float64) for c in ("n", "total", "square"))
    mean = total / n
    wide = np.sqrt(np.maximum(square / n - mean * mean, 0))
    axes = np.sort(np.argsort(-wide, kind="stable")[:AXES])
    return axes, (mean - 2 * wide)[axes], np.maximum((4 * wide)[axes], 1e-9)


def placed(v: DataFrame, dims: int) -> DataFrame:
    """(id, v, place) with the place on the curve."""
    axes, low, wide = curve_axes(v, dims)

    def place(batches):
        for batch in batches:
            x = (matrix(batch.column(1), dims)[:, axes] - low) / wide
            cells = np.clip((x * (1 << DIGITS)).astype(np.int64), 0, (1 << DIGITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, DIGITS))], names=["id", "v", "place"])

    return v.mapInArrow(place, T.StructType([*v.schema.fields, T.StructField("place", T.LongType())]))


def block_table(v: DataFrame, dims: int) -> DataFrame:
    """A written table of blocks in the curve's order: ids, body. Equal vectors are dealt on by a hash of their row's number."""
    kind = v.schema["id"].dataType.simpleString()

    def cut(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            whole = t.num_rows // TILE * TILE
            for i in range(0, whole, TILE):
                yield blocked(t.slice(i, TILE))
            rest = t.slice(whole).to_batches()
            left = rest[0] if rest else None
        if left is not None:
            yield blocked(pa.Table.from_batches([left]))

    def blocked(t: pa.Table) -> pa.RecordBatch:
        x, ids = matrix(column(t, "v"), dims), column(t, "id")
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([pack(x=x.T.ravel(), low=x.min(0), high=x.max(0))], pa.binary())], names=["ids", "body"])

    ordered = placed(v, dims).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("id", "v")
    return stash(ordered.mapInArrow(cut, f"ids array<{kind}>, body binary"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to something in the box, ties included."""
    below, above = low - centroids, centroids - high
    near = (np.maximum(np.maximum(below, above), 0).astype(object if max(np.abs(below).max(), np.abs(above).max()) > 1 << 28 else np.int64) ** 2).sum(1)
    far = (np.maximum(np.abs(centroids - low), np.abs(centroids - high)) ** 2).sum(1)
    return np.nonzero(near <= far.min())[0]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest centroids and the squared distance, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL and x.shape[1] <= 128:
        p, q = x.astype(np.float64), centroids.astype(np.float64)
        d = ((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :]) - 2.0 * (p @ q.T)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def assigned(body: bytes, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors, their clusters and distances."""
    b = unpack(body)
    x = b["x"].astype(np.int64).reshape(centroids.shape[1], -1).T
    some = candidates(b["low"].astype(np.int64), b["high"].astype(np.int64), centroids)
    best, d = nearest(x, centroids[some])
    return x, some[best], d


def sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each cluster its number of vectors and the sum of each component: k x dims rows, whatever the input."""
    k, dims = centroids.shape
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for body in batch.column(0):
                x, cluster, _ = assigned(body.as_py(), shared.value)
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                first = np.nonzero(np.concatenate([[True], np.diff(cluster[order]) > 0]))[0]
                total[cluster[order[first]]] += np.add.reduceat(x[order], first)
        c, p = (x.ravel() for x in np.mgrid[:k, :dims].astype(np.int32))
        some = n[c] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (c, p, n[c], total.ravel())], names=["cluster", "axis", "n", "total"])

    each = table.select("body").mapInArrow(add, "cluster int, axis int, n long, total long").groupBy("cluster", "axis")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(each.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def first_centroids(v: DataFrame, k: int, seed: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = v.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, dims: int, scale: int, k: int, rounds: int, seed: int, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) as a written table, and the final centroids."""
    v = integers(vectors, dims, scale, vec_id, vector)
    kind = v.schema["id"].dataType.simpleString()
    centroids = first_centroids(v, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    table = block_table(v, dims)
    for _ in range(rounds):
        for c, (n, total) in sums(table, centroids).items():
            centroids[c] = [s // n for s in total]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, c, d = assigned(batch.column(1)[i].as_py(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(c.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return stash(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")), centroids


def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(documents(spark, sf_dir, "embeddings"), **PARAMS)
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = rows.agg(F.sum("distance")).first()[0]
    each = each.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def oracle(dims: int, scale: int, k: int, rounds: int, seed: int) -> str:
    """The rounds written out one after the other."""
    near = "select vec_id, v, c.id as cluster, d from (select x.vec_id, x.v, arg_min(struct_pack(id := c.id, d := {d}), struct_pack(d := {d}, id := c.id)) as c, min({d}) as d from kept x, {c} c group by x.vec_id, x.v)"
    d = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    parts = [
        f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"c0 as materialized (select (row_number() over (order by sha256('{seed}:' || vec_id::varchar)) - 1)::integer as id, v from kept order by sha256('{seed}:' || vec_id::varchar) limit {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized ({near.format(d=d, c=f'c{i}')})")
        if i < rounds:
            parts.append(
                f"""c{i + 1} as materialized (select c.id, coalesce(m.v, c.v) as v from c{i} c left join (
  select cluster, list((((s - ((s % n) + n) % n) // n))::bigint order by p) as v from (select cluster, p, sum(x)::hugeint as s, count(*) as n from (select cluster, unnest(v) as x, unnest(range(1, {dims} + 1)) as p from a{i}) group by cluster, p) group by cluster) m on m.cluster = c.id)"""
            )
    last = rounds
    return f"""with {", ".join(parts)},
e as (select cluster, sum(d)::bigint as cluster_inertia from a{last} group by cluster)
select a.vec_id, a.cluster, a.d as distance, e.cluster_inertia, (select sum(d) from a{last})::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{last} a join e using (cluster) join c{last} c on c.id = a.cluster"""


QUERIES = {"op13_hilbert_zones": op13_hilbert_zones}
ORACLES = {"op13_hilbert_zones": oracle(**PARAMS)}
