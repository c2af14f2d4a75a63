"""Exact n-gram Jaccard join with prefix filters under several global token orders.

A document's tokens are the hashes of its word shingles. Blocks of documents ask for the document frequency of each of
their distinct tokens once, packed by ranges of the hash; frequencies only order tokens, so that a short hash does.
Two sets with Jaccard >= t share a token among the first |x| - ceil(t |x|) + 1 of x under any order that is the same
for all. All orders used here put tokens of one document first; a document whose prefix holds only those is out.

The others (equal sets once) are split into classes: first those connected by shared prefix tokens of the first order,
then, within a class, by those of the second, then of the third. Linked documents are always in one class. Every member
of a class is compared with its hub, the member of which most tokens are shared; those linked with it need not be
compared with each other, being in one component. The others are compared with all of their class: a pair must share
prefix tokens under all orders (the filters are intersected) before its sets are compared. Large classes are cut into
tiles, each pair of tiles, one of them not linked with the hub, is one task. A task returns a spanning forest of its
links, never all pairs.

Tokens stand for shingles by 64-bit hashes: two of a pair's shingles are taken for one with a chance of about
|x| |y| / 2**64, whatever the size of the corpus, as only the tokens of a pair are ever compared.

Defined cases: null and blank texts have an empty set and link with nothing; fewer words than a shingle make one
shingle of the whole; equal rows are copies of each other; a null id takes part, but the smallest id is taken of those
that are not null; columns other than id and text play no part; empty in, empty out; a text larger than a block is a
block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm.common import block_id, blocks, column, components, count_parts, documents, drop, gaps, named, pack, part_of, row_ids, runs_of, stash, trim, unpack, words_of

MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
TILE = 256
ORDERS = 3


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """Another order of 64-bit hashes for each k."""
    x = (x ^ (x >> np.uint64(31))) * MULT[k % 8]
    return (x ^ (x >> np.uint64(29))) * MULT[(k + 3) % 8]


def tokenise(batches):
    """Blocks: ids, words of each text as numbers of the block's vocabulary, the vocabulary's hashes."""
    for k, t in enumerate(blocks(batches)):
        words, counts = words_of(column(t, "text"))
        coded = words.dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(coded.dictionary, pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        ids = column(t, "doc_id")
        body = pack(tokens=coded.indices.to_numpy(), n=counts, words=hashes, ids=pc.fill_null(ids, 0).to_numpy().astype(np.int64), null=np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
        raw = int(pc.sum(pc.binary_length(column(t, "text"))).as_py() or 0)
        yield pa.RecordBatch.from_arrays([pa.array([block_id(k)], pa.int64()), pa.array([raw], pa.int64()), pa.array([body], pa.binary())], names=["block", "bytes", "body"])


def shingle_sets(b: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted, end to end; and how many each has."""
    n = b["n"].astype(np.int64)
    h = b["words"].astype(np.uint64)[b["tokens"].astype(np.int64)] if len(b["tokens"]) else np.empty(0, np.uint64)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        full += h[j : j + len(full)] * MULT[j]
    full = mix(full, 5)
    start, out = np.cumsum(n) - n, []
    for s, k in zip(start.tolist(), n.tolist(), strict=True):
        if k >= width:
            out.append(np.unique(full[s : s + k - width + 1]))
        elif k:
            out.append(mix((h[s : s + k] * MULT[:k]).sum(keepdims=True) + np.uint64(k), 6))
        else:
            out.append(full[:0])
    return np.concatenate([*out, full[:0]]), np.fromiter(map(len, out), np.int64, len(out))


def total(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n[0], n[1], ... of x; runs may be empty."""
    ends = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    at = np.concatenate([[0], np.cumsum(n)])
    return ends[at[1:]] - ends[at[:-1]]


class Sets:
    """A block's sets, the first of each kind, and the questions on their tokens."""

    def __init__(self, body: bytes, width: int, bits: int, parts: int):
        b = unpack(body)
        self.ids, self.null = b["ids"].astype(np.int64), b["null"].astype(bool)
        self.tokens, self.m = shingle_sets(b, width)
        self.sig = [total(mix(self.tokens, k), self.m).view(np.int64) for k in (1, 2)]
        _, first = np.unique(np.stack([*self.sig, self.m]), axis=1, return_index=True)
        self.first = np.zeros(len(self.m), bool)
        self.first[first] = True
        self.first &= self.m > 0
        self.short = self.tokens >> np.uint64(64 - bits)
        self.keys, self.count = np.unique(self.short[np.repeat(self.first, self.m)], return_counts=True)
        # ranges of the key, so that a partition's keys are neighbours
        self.runs = runs_of(part_of(self.keys, bits, parts))

    def ask(self):
        for p, i, j in self.runs:
            yield p, pack(h=gaps(self.keys[i:j]), n=self.count[i:j])


def asker(width: int, bits: int, parts: int):
    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                asked = list(Sets(body, width, bits, parts).ask())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(asked), pa.int64()), pa.array([p for p, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], names=["block", "part", "body"])

    return ask


def frequencies(t: pa.Table) -> pa.Table:
    got = [unpack(b) for b in t.column("body").to_pylist()]
    keys = [np.cumsum(x["h"].astype(np.uint64), dtype=np.uint64) for x in got]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(inv, weights=np.concatenate([x["n"] for x in got]), minlength=len(u)).astype(np.int64)
    out = [pack(df=df[i]) for i in np.split(inv, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})


def selector(width: int, num: int, den: int, bits: int, parts: int):
    """All documents of a block; of those that may link, once for equal sets, the shared tokens and the prefixes."""

    def select(t: pa.Table) -> pa.Table:
        part, bodies = t.column("part").to_pylist(), t.column("body").to_pylist()
        s = Sets(bodies[part.index(-1)], width, bits, parts)
        df = np.zeros(len(s.keys), np.int64)
        answers = dict(zip(part, bodies, strict=True))
        for p, i, j in s.runs:
            df[i:j] = unpack(answers[p])["df"]
        of = np.zeros(len(s.tokens), np.int64)
        mine = np.repeat(s.first, s.m)
        of[mine] = df[np.searchsorted(s.keys, s.short[mine])]
        reach = s.m - (num * s.m + den - 1) // den + 1
        may = s.first & (total((of == 1).astype(np.int64), s.m) < reach)
        start = np.cumsum(s.m) - s.m
        toks: list = [None] * len(s.m)
        pre: list[list] = [[None] * len(s.m) for _ in range(ORDERS)]
        for d in np.nonzero(may)[0]:
            u, f = s.tokens[start[d] : start[d] + s.m[d]], of[start[d] : start[d] + s.m[d]]
            toks[d] = u[f > 1].view(np.int64)
            rank = (f, np.floor(np.log2(f)), np.floor(np.log2(f) / 2))
            for k in range(ORDERS):
                at = np.lexsort((mix(u, k), rank[k]))[: reach[d]]
                pre[k][d] = u[at][f[at] > 1].view(np.int64)
        block = t.column("block")[0].as_py()
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table({
            "doc_id": pa.array(s.ids, mask=s.null), "row": pa.array(row_ids(block, len(s.m))), "n": pa.array(s.m), "sig1": pa.array(s.sig[0]), "sig2": pa.array(s.sig[1]),
            "may": pa.array(may), "shared": pa.array(total((of > 1).astype(np.int64), s.m) * 1_000_000 // np.maximum(1, s.m)), "toks": lists(toks), **{f"pre{k}": lists(pre[k]) for k in range(ORDERS)},
        })

    return trim(select)


def refine(members: DataFrame, prefix: str) -> DataFrame:
    """(row, class): documents of one class that are connected by shared tokens of prefix."""
    posts = members.select("row", "class", F.explode(prefix).alias("t"))
    low = posts.groupBy("class", "t").agg(F.min("row").alias("low"), F.count("*").alias("c")).where("c > 1").select("class", "t", "low")
    edges = posts.join(low, ["class", "t"]).where("row <> low").select(F.col("row").alias("a"), F.col("low").alias("b"))
    return components(edges).select(F.col("node").alias("row"), F.col("component").alias("class"))


def with_hubs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(row, class, hub, linked): each document, the hub of its class, whether it is linked with it (or is it)."""
    rank = F.col("shared").cast("decimal(12,0)") * F.lit(str(1 << 63)).cast("decimal(20,0)") - F.col("row").cast("decimal(20,0)")
    hubs = placed.groupBy("class").agg(F.max_by("row", rank).alias("row"), F.count("*").alias("c")).where("c > 1").select("class", "row")
    hubs = hubs.join(placed.select("row", "n", "toks"), "row").select("class", F.col("row").alias("hub"), F.col("n").alias("hub_n"), F.col("toks").alias("hub_toks"))
    both = placed.join(hubs, "class").select("row", "class", "hub", (F.col("n") + F.col("hub_n")).alias("sizes"), F.size(F.array_intersect("toks", "hub_toks")).alias("common"))
    return both.select("row", "class", "hub", ((F.col("row") == F.col("hub")) | (den * F.col("common") >= num * (F.col("sizes") - F.col("common")))).alias("linked"))


def incidence(xs: list[np.ndarray], ys: list[np.ndarray]):
    """Chunks of 0/1 matrices of xs and ys over the tokens that both have."""
    tx, ty = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(tx, ty)
    rx, ry = np.repeat(np.arange(len(xs)), list(map(len, xs))), np.repeat(np.arange(len(ys)), list(map(len, ys)))

    def place(t, r, lo, hi, n):
        k = np.searchsorted(both, t)
        ok = (k >= lo) & (k < hi) & (both[np.minimum(k, len(both) - 1)] == t)
        out = np.zeros((n, hi - lo), np.float32)
        out[r[ok], k[ok] - lo] = 1
        return out

    for lo in range(0, len(both), 8192):
        hi = min(len(both), lo + 8192)
        yield place(tx, rx, lo, hi, len(xs)), place(ty, ry, lo, hi, len(ys))


def overlap(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(xs), len(ys)), np.float32)
    for a, b in incidence(xs, ys):
        out += a @ b.T
    return out


def linked(x: dict, y: dict, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in x, index in y) with enough in common: size and prefix filters first, then the sets."""
    nx, ny = x["n"][:, None], y["n"][None, :]
    can = den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)
    if same:
        can = np.triu(can, 1)
    for k in range(ORDERS):
        if can.any():
            can &= overlap(x[f"pre{k}"], y[f"pre{k}"]) > 0
    i, j = np.nonzero(can)
    if len(i) > 2 * (len(x["n"]) + len(y["n"])):
        common = overlap(x["toks"], y["toks"])[i, j].astype(np.int64)
    else:
        common = np.fromiter((len(np.intersect1d(x["toks"][a], y["toks"][b], assume_unique=True)) for a, b in zip(i, j, strict=True)), np.int64, len(i))
    ok = den * common >= num * (x["n"][i] + y["n"][j] - common)
    return i[ok], j[ok]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links."""
    up: dict = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        rp, rq = root(p), root(q)
        if rp != rq:
            up[max(rp, rq)] = min(rp, rq)
            out.append((p, q))
    return [p for p, _ in out], [q for _, q in out]


def members_of(t: pa.Table) -> dict:
    lists = lambda name: [np.asarray(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else np.empty(0, np.int64) for v in column(t, name)]
    return {"row": column(t, "row").to_numpy(), "n": column(t, "n").to_numpy(), "toks": lists("toks"), **{f"pre{k}": lists(f"pre{k}") for k in range(ORDERS)}}


def verifier(num: int, den: int):
    """Links within each class of a group; of a tile of a large class also its members, packed, for the other tiles."""

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        cls, tile, near = column(t, "class").to_numpy(), t.column("tile")[0].as_py(), t.column("opens")[0].as_py()
        edge = np.concatenate([[0], np.nonzero(np.diff(cls))[0] + 1, [len(cls)]])
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo > 1 and tile < near:
                x = members_of(t.slice(lo, hi - lo))
                i, j = linked(x, x, num, den, True)
                p, q = forest(x["row"][i], x["row"][j])
                a, b = a + p, b + q
        out = {"class": pa.array([None] * len(a), pa.int64()), "tile": pa.array([None] * len(a), pa.int32()), "tiles": pa.array([None] * len(a), pa.int32()), "opens": pa.array([None] * len(a), pa.int32()), "body": pa.array([None] * len(a), pa.binary()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}
        out = pa.table(out)
        if tile >= 0:
            x = members_of(t)
            flat = {"row": x["row"], "n": x["n"]} | {k: np.concatenate(x[k]) for k in x if k not in ("row", "n")} | {f"{k}_n": np.fromiter(map(len, x[k]), np.int64) for k in x if k not in ("row", "n")}
            own = pa.table({"class": t.column("class").slice(0, 1), "tile": t.column("tile").slice(0, 1), "tiles": t.column("tiles").slice(0, 1), "opens": t.column("opens").slice(0, 1), "body": pa.array([pack(**flat)], pa.binary()), "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})
            out = pa.concat_tables([out, own.cast(out.schema)])
        return out

    return verify


def unpacked(body: bytes) -> dict:
    f = unpack(body)
    cut = lambda k: np.split(f[k], np.cumsum(f[f"{k}_n"].astype(np.int64))[:-1])
    return {"row": f["row"].astype(np.int64), "n": f["n"].astype(np.int64), "toks": cut("toks"), **{f"pre{k}": cut(f"pre{k}") for k in range(ORDERS)}}


def crosser(num: int, den: int):
    def cross(t: pa.Table) -> pa.Table:
        bodies = [unpacked(b) for b in t.column("body").to_pylist()]
        i, j = linked(bodies[0], bodies[1], num, den, False)
        a, b = forest(bodies[0]["row"][i], bodies[1]["row"][j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cross


def join(docs: DataFrame, width: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; two link if den * common >= num * union."""
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    table = stash(source.mapInArrow(tokenise, "block long, bytes long, body binary"))
    parts = count_parts(table, "bytes")
    bits = min(62, 36 + parts.bit_length())
    head = "block long, part int, body binary"
    asked = table.select("block", "body").mapInArrow(asker(width, bits, parts), head)
    told = stash(asked.groupBy("part").applyInArrow(trim(frequencies), head))
    lists = ", ".join(f"pre{k} array<long>" for k in range(ORDERS))
    rows = table.select("block", F.lit(-1).alias("part"), "body").unionByName(told)
    found = stash(rows.groupBy("block").applyInArrow(selector(width, num, den, bits, parts), f"doc_id long, row long, n long, sig1 long, sig2 long, may boolean, shared long, toks array<long>, {lists}"))

    drop(table, told)
    may = found.where("may")
    reps = may.groupBy("sig1", "sig2").agg(F.min("row").alias("row"))
    members = stash(may.join(reps.select("row"), "row").drop("doc_id", "sig1", "sig2", "may"))
    classes = refine(members.withColumn("class", F.lit(0).cast("long")), "pre0")
    for k in range(1, ORDERS):
        classes = refine(members.join(classes, "row"), f"pre{k}")
    placed = stash(members.join(classes, "row"))
    star = stash(with_hubs(placed, num, den))

    # classes with members that are not linked with their hub; those come first in the count of tiles
    near = star.withColumn("open", ~F.col("linked")).groupBy("class").agg(F.count_if("open").alias("n_open"), F.count("*").alias("n")).where("n_open > 0 and n > 1")
    tiles = F.ceil(F.col("n_open") / tile).cast("int"), F.ceil((F.col("n") - F.col("n_open")) / tile).cast("int")
    near = near.select("class", F.when(F.col("n") > tile, tiles[0]).otherwise(1).alias("opens"), F.when(F.col("n") > tile, tiles[0] + tiles[1]).otherwise(1).alias("tiles"))
    at = lambda n: F.pmod(F.xxhash64("row"), n)
    tile_of = F.when(F.col("tiles") == 1, -1).when(~F.col("linked"), at(F.col("opens"))).otherwise(F.col("opens") + at(F.greatest(F.lit(1), F.col("tiles") - F.col("opens")))).cast("int")
    rows_each = max(1, members.count() // 2000)
    group = F.when(F.col("tiles") > 1, F.col("class")).otherwise(F.pmod(F.xxhash64("class"), F.lit(rows_each)))
    rest = placed.join(star.select("row", "linked"), "row").join(near, "class").withColumn("tile", tile_of).withColumn("group", group).drop("linked", "shared")
    out = stash(rest.groupBy("group", "tile").applyInArrow(verifier(num, den), "class long, tile int, tiles int, opens int, body binary, a long, b long"))
    drop(members, placed)
    large = out.where("body is not null")
    partner = F.explode(F.sequence(F.lit(0), F.when(F.col("tile") < F.col("opens"), F.col("tiles")).otherwise(F.col("opens")) - 1))
    sent = large.select("class", "tile", "body", partner.alias("other")).where("tile <> other").select("class", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "body")
    crossed = sent.groupBy("class", "i", "j").applyInArrow(crosser(num, den), "a long, b long")
    stars = star.where("linked and row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    low = components(stars.unionByName(out.where("a is not null").select("a", "b")).unionByName(crossed))

    kinds = found.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("lo"))
    kinds = kinds.join(reps, ["sig1", "sig2"], "left").join(low, F.col("row") == F.col("node"), "left").select("sig1", "sig2", "n", "lo", F.coalesce("component", "row").alias("g"))
    kinds = stash(kinds)
    lowest = kinds.where("g is not null").groupBy("g").agg(F.min("lo").alias("c"))
    kinds = kinds.join(lowest, "g", "left").select("sig1", "sig2", F.coalesce("c", "lo").alias("c"), F.lit(True).alias("some"))
    done = found.select("doc_id", "n", "sig1", "sig2", (F.col("n") > 0).alias("some")).join(kinds, ["sig1", "sig2", "some"], "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def keep(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all columns."""
    kept = join(docs, width, num, den, doc_id, text).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    whole = docs.select(F.struct(*map(named, docs.columns)).alias("doc"), named(doc_id).cast("long").alias("id"))
    return whole.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), 4, 85, 100)


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLES = {
    "op5_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as t from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as c from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, m.c as component_id from documents left join n using (doc_id) join m on m.a = doc_id
"""
}
