"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label are rotated to their principal axes and cut into tiles along the first two. Runs of tiles, then
tiles of the runs that are left, meet only if the best product their bounds allow reaches the threshold. In a task, products of the leading axes are summed
first; what the other axes can add is bounded by the product of the suffix norms, and only pairs that can still reach
the threshold go on. Decisions near the threshold are made on the vectors as given, in double precision. The rotation
is orthogonal: the sample that it is fitted on changes the speed, never the result.

Equal vectors of a label are compared once and counted with their number. A task returns link counts and a spanning
forest of its links, never all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing;
vectors of other lengths don't link; each row counts as a vector; other columns play no part; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm.common import column, components, documents, named, pack, stash, unpack

#: Vectors that the rotation is fitted on (a bound, not a share), vectors in a tile, axes with tile bounds, tiles of a run.
FIT, TILE, LEAD, RUN = 20_000, 1024, 8, 64
SLACK = 1e-9


def usable(v: str, label: str):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & F.col(label).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def fit_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length the axes in order of variance, from at most about FIT vectors."""
    n = vectors.count()
    hit = F.pmod(F.xxhash64("rk", F.lit("fit")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, FIT / max(1, n))))
    sample: dict[int, list] = {}
    for r in vectors.where(hit).select("v").toLocalIterator():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    axes = {}
    for d, rows in sample.items():
        x = unit(np.asarray(rows, np.float64))
        axes[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of threshold or more."""
    a, b = unit(x) @ axes, unit(y) @ axes
    d = a.shape[1]
    lead = min(LEAD, d)
    near = a[:, :lead] @ b[:, :lead].T
    rest = lambda z, k: np.sqrt((z[:, k:] ** 2).sum(1))
    can = near + np.outer(rest(a, lead), rest(b, lead)) >= threshold - SLACK
    i, j = np.nonzero(can)
    if len(i) > can.size // 8:  # dense: one product of whole tiles is cheaper than gathering
        near = near + a[:, lead:] @ b[:, lead:].T
        linked = near >= threshold
        i, j = np.nonzero(np.abs(near - threshold) <= SLACK)
        linked[i, j] = exact(x, y, i, j) >= threshold
        return linked
    so_far, at = near[i, j], lead
    while at < d and len(i):
        to = min(d, 2 * at)
        so_far = so_far + np.einsum("ij,ij->i", a[i, at:to], b[j, at:to])
        on = so_far + rest(a, to)[i] * rest(b, to)[j] >= threshold - SLACK
        i, j, so_far, at = i[on], j[on], so_far[on], to
    close = np.abs(so_far - threshold) <= SLACK
    so_far[close] = exact(x, y, i[close], j[close])
    linked = np.zeros(can.shape, bool)
    linked[i, j] = so_far >= threshold
    return linked


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    p, q = x[i], y[j]
    return (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) of the bipartite links."""
    la, lb, none = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], none).min(1, initial=none))
        nb = np.minimum(lb, np.where(linked, na[:, None], none).min(0, initial=none))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    node, low = np.concatenate([left, right]), np.concatenate([la, lb])
    return node[node != low], low[node != low]


def meeting(x: DataFrame, y: DataFrame, name: str, threshold: float, *on: str) -> DataFrame:
    """Pairs of rows of one label and length, x's name up to y's (name2), whose bounds allow a product of threshold."""
    keys = ["label", "d", *on]
    y = y.select(*keys, *[F.col(c).alias(f"{c}2") for c in (name, "low", "high", "rest")])
    products = lambda p, q: F.greatest(p["low"] * q["low2"], p["low"] * q["high2"], p["high"] * q["low2"], p["high"] * q["high2"])
    # vectors with fewer axes have nulls there
    best = F.aggregate(F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"), products), F.lit(0.0), lambda acc, z: acc + F.coalesce(z, F.lit(0.0)))
    order = F.lit(True) if on else F.col(name) <= F.col(f"{name}2")
    return x.join(y, keys).where(order & (best + F.col("rest") * F.col("rest2") >= threshold - SLACK))


def links(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """vectors: (rk, rep, label, v, copies), distinct. Gives (rk, n) and the edges (a, b) between reps."""
    axes = fit_axes(vectors)
    tiles_of = F.ceil(F.col("n") / TILE).cast("int")
    sizes = vectors.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).select("label", "d", tiles_of.alias("tiles"))

    def blocked(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            v = column(t, "v")
            lens = np.diff(v.offsets.to_numpy())
            values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lead = np.zeros((2, len(lens)))
            ends = np.cumsum(lens)
            for d in np.unique(lens):
                rows = np.nonzero(lens == d)[0]
                x = values[(ends[rows] - d)[:, None] + np.arange(d)]
                if d in axes:
                    lead[: min(2, d), rows] = (unit(x) @ axes[d][:, :2]).T
            yield pa.RecordBatch.from_arrays([t.column(n).combine_chunks() for n in ("rk", "rep", "label", "v", "copies")] + [pa.array(x) for x in lead], names=["rk", "rep", "label", "v", "copies", "first", "second"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    placed = stash(vectors.select("rk", "rep", "label", "v", "copies").mapInArrow(blocked, f"rk long, rep long, label {kinds['label']}, v {kinds['v']}, copies long, first double, second double"))
    # Cuts along two axes from quantiles of each label; Spark's sketch is of bounded size for each label.
    quantiles = lambda c: F.percentile_approx(c, [k / 64 for k in range(1, 64)], 2000)
    cuts = placed.groupBy("label", F.size("v").alias("d")).agg(quantiles("first").alias("cuts"), quantiles("second").alias("cuts2"))
    cuts = cuts.join(sizes, ["label", "d"])
    cell = lambda c, cuts_: F.aggregate(cuts_, F.lit(0), lambda acc, x: acc + F.when(F.col(c) > x, 1).otherwise(0))
    # Up to 64 tiles are runs of the first axis's cells; more are cells cut along the second axis, beyond 4,096 also by hash.
    each = F.ceil(F.col("tiles") / 64)
    deep = F.greatest(F.lit(1), F.ceil(each / 64))
    below = F.when(each <= 64, F.floor(cell("second", "cuts2") * each / 64)).otherwise(cell("second", "cuts2") * deep + F.pmod(F.xxhash64("rk", F.lit("tile")), deep))
    tile = F.when(F.col("tiles") <= 64, F.floor(cell("first", "cuts") * F.col("tiles") / 64)).otherwise(cell("first", "cuts") * F.when(each <= 64, each).otherwise(64 * deep) + below).cast("int")
    tiled = placed.withColumn("d", F.size("v")).join(cuts, ["label", "d"]).select("label", "d", tile.alias("tile"), "rk", "rep", "v", "copies")

    def gather(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        x = column(t, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
        a = unit(x) @ axes.get(d, np.eye(d))
        body = pack(rk=column(t, "rk").to_numpy(), rep=column(t, "rep").to_numpy(), copies=column(t, "copies").to_numpy(), v=x.astype(np.float32).ravel() if pa.types.is_float32(t.schema.field("v").type.value_type) else x.ravel())
        lead = a[:, :LEAD]
        low, high, rest = lead.min(0), lead.max(0), np.sqrt((a[:, LEAD:] ** 2).sum(1)).max()
        return pa.table([t.column("label").slice(0, 1), t.column("d").slice(0, 1), t.column("tile").slice(0, 1), pa.array([low.tolist()]), pa.array([high.tolist()]), pa.array([float(rest)]), pa.array([body], pa.binary())], names=["label", "d", "tile", "low", "high", "rest", "body"])

    head = f"label {kinds['label']}, d int, tile int"
    tiles = stash(tiled.groupBy("label", "d", "tile").applyInArrow(gather, f"{head}, low array<double>, high array<double>, rest double, body binary"))
    bounds = tiles.select("label", "d", F.floor(F.col("tile") / RUN).alias("run"), "tile", "low", "high", "rest")
    # Runs of tiles first, so that a label's tiles are not all met with each other.
    ends = lambda f, c: F.array(*[f(F.get(c, F.lit(k))) for k in range(LEAD)]).alias(c)
    wide = bounds.groupBy("label", "d", "run").agg(ends(F.min, "low"), ends(F.max, "high"), F.max("rest").alias("rest"))
    near = meeting(wide, wide, "run", threshold).select("label", "d", "run", F.col("run2").alias("other"))
    one, two = near.join(bounds, ["label", "d", "run"]), bounds.withColumnRenamed("run", "other")
    pairs = meeting(one, two, "tile", threshold, "other").select("label", "d", "tile", F.col("tile2").alias("t2"))
    pairs = pairs.select("label", "d", F.least("tile", "t2").alias("tile"), F.greatest("tile", "t2").alias("t2")).distinct()
    sides = pairs.select("label", "d", F.col("tile").alias("i"), F.col("t2").alias("j"), F.explode(F.array_distinct(F.array("tile", "t2"))).alias("tile"))
    sent = tiles.select("label", "d", "tile", "body").join(sides, ["label", "d", "tile"])

    def meet(t: pa.Table) -> pa.Table:
        d, i, j = (t.column(n)[0].as_py() for n in ("d", "i", "j"))
        by = {k: unpack(b) for k, b in zip(t.column("tile").to_pylist(), t.column("body").to_pylist(), strict=True)}
        p, q = by[i], by[j]
        v = lambda z: z["v"].reshape(-1, d).astype(np.float64)
        linked = compare(v(p), v(q), axes.get(d, np.eye(d)), threshold)
        if i == j:
            np.fill_diagonal(linked, False)
            linked |= linked.T
        keys, counts = [p["rk"]], [linked @ q["copies"].astype(np.int64)]
        if i != j:
            keys, counts = [*keys, q["rk"]], [*counts, linked.T @ p["copies"].astype(np.int64)]
        key, n = np.concatenate(keys).astype(np.int64), np.concatenate(counts)
        a, b = forest(linked, p["rep"].astype(np.int64), q["rep"].astype(np.int64)) if linked.any() else (key[:0], key[:0])
        key, n = key[n > 0], n[n > 0]
        nulls = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"rk": pa.concat_arrays([pa.array(key), nulls(len(a))]), "n": pa.concat_arrays([pa.array(n.astype(np.int64)), nulls(len(a))]), "a": pa.concat_arrays([nulls(len(key)), pa.array(a)]), "b": pa.concat_arrays([nulls(len(key)), pa.array(b)])})

    out = stash(sent.groupBy("label", "d", "i", "j").applyInArrow(meet, "rk long, n long, a long, b long"))
    return out.where("rk is not null").groupBy("rk").agg(F.sum("n").alias("n")), out.where("a is not null").select("a", "b")


def near_vectors(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = vectors.select(named(vec_id).alias("vec_id"), named(label).alias("label"), F.transform(named(embedding), lambda x: x + F.lit(0).cast("float")).alias("v") if dict(vectors.dtypes)[embedding] == "array<float>" else named(embedding).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable("v", "label"), F.lit(False)))
    # equal vectors by their values, not by a hash of them
    kinds = stash(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    good = stash(kinds.withColumn("rk", F.monotonically_increasing_id()))
    counts, edges = links(good, threshold)
    low = components(edges)
    found = (
        good.join(counts, "rk", "left").join(low, good["rep"] == low["node"], "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), "v").join(found, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"), 0.93)


QUERIES = {"op4_pca_tiles": op4_pca_tiles}
ORACLES = {
    "op4_pca_tiles": """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where label is not null and embedding is not null),
n as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from e),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0 and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93::double),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, c as component_id, vec_id = c as kept from embeddings join c on a = vec_id
"""
}
