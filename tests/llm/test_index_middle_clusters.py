"""FM-index decontamination, fill-in-middle and centroid clustering against brute force and their SQL."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafworks.llm import clusters, fim, fmindex, registry

SF = "/root/testdata/sf0.001"
NAMES = ["op11_fm_index", "op12_chunk_memo", "op13_hilbert_zones"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = registry.queries()[name](spark, SF), con.sql(registry.oracles()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


# --- index ---
@pytest.mark.parametrize("seed, sigma, n", [(1, 2, 400), (2, 3, 1000), (3, 50, 2000), (4, 1, 70), (5, 1, 0)])
def test_suffix_ranks_and_searches(seed, sigma, n):
    r = np.random.default_rng(seed)
    ids = r.integers(0, sigma, n)
    n_words = np.array([n // 3, 0, n - n // 3])
    body = fmindex.built(ids, n_words, sigma)
    t = [x + 2 for x in ids[: n // 3]] + [1, 1] + [x + 2 for x in ids[n // 3 :]] + [1, 0]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    assert np.argsort(fmindex.suffix_ranks(np.array(t))).tolist() == order
    shard = fmindex.Shard(fmindex.unpack(fmindex.pack(**body)))
    assert shard.locate(np.arange(len(t))).tolist() == order
    for size in (1, 2, 5):
        for _ in range(20):
            p = r.integers(2, sigma + 2, size)
            low, count = shard.search(p[None, :], np.array([size]))
            assert sorted(order[low[0] : low[0] + count[0]]) == [i for i in range(len(t)) if t[i : i + size] == p.tolist()]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


DOCS = [(1, "A b, c d! e f g"), (2, None), (3, ""), (4, "..."), (5, "É é x1-x2 a b c"), (5, "É é x1-x2 a b c"), (None, "c d e"), (7, "a " * 500 + "b"), (8, "b c\x00d\x7fe_f"), (9, "end"), (10, "end")]
ITEMS = [(1, "b c d e f"), (2, "x1 x2"), (2, "zz"), (3, None), (4, "!?"), (None, "c d e"), (11, "A A A"), (12, "end end"), (13, "é É"), (1, "b c d e f")]


@pytest.mark.parametrize("chunk, block, size", [(1 << 19, 8 << 20, 3), (2, 8 << 20, 3), (3, 16, 4), (1 << 19, 1, 2)])
def test_hits_match_brute_force(spark, monkeypatch, chunk, block, size):
    """Several chunks of the benchmark, items cut between chunks, and shards of one text."""
    monkeypatch.setattr(fmindex, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(fmindex, "blocks", lambda batches, limit=block, cut=fmindex.blocks: cut(batches, limit))
    r = random.Random(6)
    docs = DOCS + [(100 + k, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60)))) for k in range(40)]
    items = ITEMS + [(50 + k, " ".join(r.choice("abcde") for _ in range(r.randint(1, 9)))) for k in range(12)]
    shards = fmindex.index(spark.createDataFrame(docs, "doc_id int, text string").repartition(3))
    got = fmindex.find(shards, spark.createDataFrame(items, "item_id int, text string"), size).collect()
    found = sorted(((x.doc_id, x.n_words, [k for s in x.spans for k in range(s.begin, s.end)], x["items"]) for x in got), key=repr)
    assert found == [(d, n, hit, sorted(set(i))) for d, n, hit, i in brute_hits(docs, items, size)]
    texts = dict(docs)
    for x in got:
        assert all(a.end < b.begin for a, b in zip(x.spans, x.spans[1:]))
        for s in x.spans:
            assert words(texts[x.doc_id].encode()[s.from_byte : s.to_byte].decode()) == words(texts[x.doc_id])[s.begin : s.end]


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert {(len(x.spans), len(x["items"])) for x in fmindex.find(fmindex.index(docs), items).collect()} == {(0, 0)}
    assert fmindex.find(fmindex.index(docs.limit(0)), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_texts_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "Say: A b, c! and é", 1, "x"), (1, None, 2, "y"), (3, "a b c", 3, None), (4, "none", 4, "z")], "doc_id int, text string, row int, `sp ans` string")
    got = fmindex.clean(docs, spark.createDataFrame([(1, "a B c")], "item_id int, text string"), 3)
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == [(1, "Say: ! and é", 1, "x"), (1, None, 2, "y"), (3, "", 3, None), (4, "none", 4, "z")]


# --- middles ---
def brute_middle(doc_id, text, seed, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def middles():
    r = random.Random(2)
    line = lambda: "".join(r.choice("abé<>PSM𝄞 ") for _ in range(r.randint(0, 80)))
    shared = "\n".join(line().replace("<", "") for _ in range(200))
    rows = [(k, "\n".join([line().replace("<", ""), shared, line().replace("<", "")] + [line() for _ in range(r.randint(0, 3))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n\n"), (104, "a" * 100_000), (105, "a" * 70_000 + "\n" + "b" * 50_000), (None, "x\ny\nz"), (None, "x\ny\nz"), (106, "one<"), (107, "<\nS>"), (108, "<<P\n>\n")]
    return rows + [(200 + k, "y" * (fim.MOST - 2 + k) + "<S>" + "z\n" * 5) for k in range(5)] + [(300 + k, "é" * 9_000 + "\n" * k) for k in range(5)]


@pytest.mark.parametrize("rate, spm", [(100, 50), (50, 0), (0, 50)])
def test_middles_match_brute_force(spark, rate, spm):
    rows = middles()
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id int, text string, fim string").repartition(2)
    out = fim.transform(docs, rate=rate, spm=spm)
    got = out.select("rest.doc_id", "rest.text", "rest.fim", F.col("fim.n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("again")).collect()
    assert all(x.again == (x.text or "") for x in got)
    assert sorted((repr((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output)) for x in got)) == sorted(repr((d, *brute_middle(d, t, 7, rate, spm))) for d, t in rows)


def test_chunks_are_shared_and_bounded():
    r = random.Random(3)
    text = lambda n: bytes(r.randrange(32, 127) for _ in range(n))
    common = text(100_000)
    texts = [text(700) + common + text(300), text(5_000) + common, b"a" * 60_000, b"", b"ab"]
    at = np.cumsum([0, *map(len, texts)])
    ends = fim.boundaries(np.frombuffer(b"".join(texts), np.uint8), at)
    for t, s, e in zip(texts, at[:-1], ends, strict=True):
        e = [x - s for x in e]
        assert (e[-1:] or [0]) == [len(t)] and all(0 < b - a <= fim.MOST for a, b in zip([0, *e], e))
    cache = fim.Chunks()
    for t, s, e in zip(texts, at[:-1], ends, strict=True):
        fim.Cut(t, [x - s for x in e], cache)
    assert cache.hits > 20
    alone = fim.boundaries(np.frombuffer(texts[1], np.uint8), np.array([0, len(texts[1])]))[0]
    assert alone == [x - at[1] for x in ends[1]]


def test_a_small_cache_and_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(fim, "hash", lambda body: len(body) % 2, raising=False)
    small, text = fim.Chunks(10), "\n".join(f"line {k} é" for k in range(3_000)).encode()
    ends = fim.boundaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    cut = fim.Cut(text, ends, small)
    assert cut.units == 3_000 and small.used <= max(10, fim.MOST) and small.hits < len(ends)
    for u in (0, 1, 1_500, 2_999, 3_000):
        byte, point = cut.place(u)
        assert text[:byte].decode() == "".join(f"line {k} é\n" for k in range(u))[: point] and len(text[:byte].decode()) == point


# --- clusters ---
def brute_clusters(rows, dims, scale, k, rounds, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < 1 << 27]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, _, v in sorted((name(i), v, v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def vectors(dims):
    r = np.random.default_rng(8)
    centre = r.normal(size=(5, dims)) / 4
    rows = [(i, (centre[i % 5] + r.normal(size=dims) * (0.05 if i % 3 else 0.3)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(3, rows[7][1]), (3, rows[7][1]), (None, rows[9][1]), (None, rows[10][1])]
    one = [0.5] * dims
    return rows + [(300, None), (301, one[1:]), (302, [*one, 1.0]), (303, [None, *one[1:]]), (304, [float("nan"), *one[1:]]), (305, [float("-inf"), *one[1:]]), (306, [0.0] * dims), (307, [3e38, *one[1:]]), (308, [1e5, *one[1:]]), (309, [])]


@pytest.mark.parametrize("tile, k", [(512, 6), (7, 6), (7, 1), (16, 1000)])
def test_clusters_match_brute_force(spark, monkeypatch, tile, k):
    monkeypatch.setattr(clusters, "TILE", tile)
    rows = vectors(8)
    table = spark.createDataFrame([(*x, 1) for x in rows], "vec_id int, embedding array<float>, cluster int").repartition(3)
    got, centroids = clusters.cluster(table, 8, 256, k, 3, 2)
    want, middle = brute_clusters(rows, 8, 256, k, 3, 2)
    assert centroids.tolist() == middle
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_no_vectors_no_clusters(spark):
    table = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    got, _ = clusters.cluster(table, 2, 256, 3, 2, 2)
    assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 0


@pytest.mark.parametrize("digits, n", [(1, 6), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_all_cells_by_steps_of_one(digits, n):
    cells = np.stack(np.meshgrid(*[np.arange(1 << digits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = clusters.hilbert(cells, digits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("wide", [3, 1000, 1 << 24, (1 << 27) - 1])
def test_bounds_lose_no_nearest_centroid(wide):
    r = np.random.default_rng(wide)
    for _ in range(30):
        c = r.integers(-wide, wide + 1, (12, 5))
        x = np.clip(r.integers(-wide, wide + 1, 5) + r.integers(-(wide // 8) - 1, wide // 8 + 2, (40, 5)), -wide, wide)
        some = clusters.candidates(x.min(0), x.max(0), c)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, y)) for y in c] for v in x]
        best, d = clusters.nearest(x, c[some])
        assert some[best].tolist() == [e.index(min(e)) for e in exact] and d.tolist() == [min(e) for e in exact]
    assert pa.array(d).type == pa.int64()
