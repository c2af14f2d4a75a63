"""Vector comparison, archives and SentencePiece coding against brute force and round trips."""

import gzip
import hashlib
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafworks.llm import embeddings, pieces, warc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# --- vectors ---
def vectors():
    r = np.random.default_rng(4)
    rows = []
    centre = r.normal(size=16)
    for i in range(160):
        v = r.normal(size=16) if i % 4 else centre + r.normal(size=16) * (0.05 + 0.3 * (i % 3))
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(200 + k, rows[0][1], 0) for k in range(5)] + [(210, rows[0][1], 1), (211, rows[0][1], None)]
    rows += [(220, None, 0), (221, [0.0] * 16, 0), (222, [float("nan")] + [1.0] * 15, 0), (223, [float("inf")] + [1.0] * 15, 0), (224, [None] + [1.0] * 15, 0), (225, [], 0), (226, [1.0] * 8, 0), (227, [1.0] * 8, 0)]
    return rows


def brute_links(rows, threshold):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, p, a), (_, q, b) = rows[i], rows[j]
            if a is not None and a == b and usable(p) and usable(q) and len(p) == len(q):
                x, y = np.array(p), np.array(q)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    low = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low[i] = min(rows[k][0] for k in seen)
    return sorted((rows[i][0], len(links[i]), low[i], low[i] == rows[i][0]) for i in range(n))


@pytest.mark.parametrize("tile, run", [(1024, 64), (16, 4), (1, 8)])
def test_links_match_brute_force(spark, monkeypatch, tile, run):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "RUN", run)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rk int, tile string").repartition(3)
    got = embeddings.near_vectors(df, 0.9)
    assert sorted(map(tuple, got.collect())) == brute_links(rows, 0.9)
    assert embeddings.near_vectors(df.where("false"), 0.9).count() == 0


def test_bounds_lose_no_pair():
    r = np.random.default_rng(1)
    base = r.normal(size=(3, 20))
    x = np.concatenate([base[k % 3] + r.normal(size=20) * 0.2 for k in range(90)]).reshape(90, 20)
    y = r.normal(size=(70, 20))
    for p, q in ((x, x), (x, y), (y, x[:40])):
        u, v = embeddings.unit(p), embeddings.unit(q)
        axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
        assert (embeddings.compare(p, q, axes, 0.93) == (u @ v.T >= 0.93)).all()


# --- archives ---
PAGE = "page_id long, url string, payload binary"


def pages(r=random.Random(9)):
    big = [bytes(r.choices(b"abcdefgh \r\n", k=1500)) for _ in range(4)]
    rows = [(i, f"http://h{i % 3}.example/{i}", big[i % 4] if i % 2 else f"page {i}".encode() * (i % 40)) for i in range(60)]
    return [*rows, (100, None, None), (101, "http://x.example/\r\nbad", b""), (102, "u", b"WARC/1.1\r\n\r\n" * 200), (103, "u", "é".encode() * 5000), (5, "again", big[1]), (None, "none", b"z" * 1200)]


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, PAGE).repartition(3)
    warc.register(spark)
    warc.to_records(warc.mark_revisits(df)).write.format("warc").mode("append").save(str(tmp_path / "a"))
    got = sorted(map(tuple, warc.read_back(spark, str(tmp_path / "a")).collect()), key=repr)
    last = {}
    for i, _, p in rows:
        if p and len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, -1), i)
    want = []
    for i, _, p in rows:
        p = p or b""
        again = i is not None and last.get(p, i) > i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None))
    assert got == sorted(want, key=repr)


def test_predicates_and_skipped_payloads(spark, tmp_path):
    warc.register(spark)
    df = spark.createDataFrame(pages(), PAGE).coalesce(1)
    path = str(tmp_path / "a")
    warc.to_records(warc.mark_revisits(df)).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    assert read.where("target_uri like 'http://h1.example/%' and record_type = 'revisit'").count() == read.where("record_type = 'revisit'").toPandas()["target_uri"].str.startswith("http://h1.example/").sum()
    assert read.where("record_id in ('<urn:x-page:102>', '<urn:x-page:7>')").count() == 2
    heads = spark.read.format("warc").schema("record_id string, payload_length long").load(path)
    assert heads.count() == len(pages())
    # the same records as a plain file, and as members that don't carry their length
    raw = b"".join(gzip.open(f).read() for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz"))
    foreign(raw, "x.warc", tmp_path / "plain")
    foreign(raw, "x.warc.gz", tmp_path / "foreign")
    key = lambda p: plain_rows(spark.read.format("warc").load(str(p)))
    assert key(path) == key(tmp_path / "plain") == key(tmp_path / "foreign")
    assert spark.read.format("warc").load(str(tmp_path / "foreign")).where("record_id = '<urn:x-page:102>'").count() == 1


def plain_rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in df.collect()), key=repr)


def test_appends_add_and_overwriting_replaces(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "a")
    part = lambda k: warc.to_records(warc.mark_revisits(spark.createDataFrame([(10 * k + j, f"u{j}", b"x" * (j + 1)) for j in range(3)], PAGE)))
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(path).select("record_id").collect())
    want = lambda *ks: sorted(f"<urn:x-page:{10 * k + j}>" for k in ks for j in range(3))
    part(0).write.format("warc").mode("append").save(path)
    part(1).write.format("warc").mode("append").save(path)
    assert ids() == want(0, 1)
    part(2).write.format("warc").mode("overwrite").save(path)
    assert ids() == want(2)
    listed = warc.listing(*warc.opened(path))[1]
    assert {f.name for f in (tmp_path / "a").iterdir() if f.name.endswith(".gz")} == set(listed)  # the old files are gone
    part(3).write.format("warc").mode("append").save(path)
    assert ids() == want(2, 3)


def test_appends_hide_no_archive(spark, tmp_path, monkeypatch):
    """Foreign archives before and after the first commit, archives of ours without a manifest, many commits made one."""
    monkeypatch.setattr(warc, "MANIFESTS", 3)
    warc.register(spark)
    path, n = str(tmp_path / "a"), lambda p: spark.read.format("warc").load(p).count()
    page = lambda k: warc.to_records(warc.mark_revisits(spark.createDataFrame([(k, f"u{k}", b"x" * (k + 1))], PAGE))).coalesce(1)
    raw = b"".join(gzip.decompress(warc.member(r.asDict())) for k in range(3) for r in page(k).collect())
    foreign(raw, "other.warc.gz", tmp_path / "a")
    assert n(path) == 3
    page(10).write.format("warc").mode("append").save(path)
    assert n(path) == 4
    (tmp_path / "a" / "later.warc").write_bytes(raw)
    assert n(path) == 7
    schema = ["record_type", "record_id", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_length", "content_type", "payload"]
    for k in range(11, 16):
        writer = warc.WarcWriter(path, False)
        writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([{c: r[c] for c in schema if c in r} for r in (x.asDict() for x in page(k).collect())])]))])
    assert n(path) == 12 and len([f for f in (tmp_path / "a").iterdir() if f.name.startswith(warc.MANIFEST)]) <= 3
    (tmp_path / "b").mkdir()
    for f in (tmp_path / "a").iterdir():
        if warc.OURS.match(f.name):
            (tmp_path / "b" / f.name).write_bytes(f.read_bytes())
    assert n(str(tmp_path / "b")) == 6
    page(20).write.format("warc").mode("append").save(str(tmp_path / "b"))
    assert n(str(tmp_path / "b")) == 7
    page(21).write.format("warc").mode("overwrite").save(path)
    assert n(path) == 1


def test_planning_reads_names_and_sizes_only(spark, tmp_path):
    """A thousand archives: what the driver holds are ranges of bytes, and manifests hold names, no starts."""
    warc.register(spark)
    writer = warc.WarcWriter(str(tmp_path / "a"), False)
    row = {"record_type": "response", "record_id": "<urn:x:1>", "payload": b"p" * 50}
    done = []
    for _ in range(1000):
        done.append(writer.write(iter([pa.RecordBatch.from_pylist([{c.split()[0]: row.get(c.split()[0]) for c in warc.SCHEMA.split(", ")}])])))
    writer.commit(done)
    assert max(len(str(m.files)) for m in done) < 60
    manifest = next(f for f in (tmp_path / "a").iterdir() if f.name.startswith(warc.MANIFEST))
    assert manifest.stat().st_size < 1000 * 50
    reader = warc.WarcReader(str(tmp_path / "a"), spark.createDataFrame([], warc.SCHEMA).schema, 100_000)
    parts = reader.partitions()
    assert sum(len(p.ranges) for p in parts) == 1000 and 2 <= len(parts) <= 10
    assert spark.read.format("warc").load(str(tmp_path / "a")).count() == 1000


def foreign(raw, name, folder):
    """The records of raw (a plain archive) as a plain file, or as members that don't carry their length."""
    cut, members = 0, []
    while cut < len(raw):
        headers, begin = warc.parse_head(raw[cut:])
        end = cut + begin + int(headers["content-length"]) + 4
        members.append(raw[cut:end])
        cut = end
    folder.mkdir()
    (folder / name).write_bytes(b"".join(map(gzip.compress, members) if name.endswith("gz") else members))


def test_large_files_are_split_at_record_starts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 2000)  # of the writer on the driver below
    path = tmp_path / "a"
    writer = warc.WarcWriter(str(path), False)
    records = warc.to_records(warc.mark_revisits(spark.createDataFrame(pages(), PAGE))).coalesce(1).toArrow()
    inner = {"record_type": "response", "record_id": "in", "payload": b"".join(warc.member({"record_id": f"no{k}", "payload": b"n"}) for k in range(40))}
    writer.commit([writer.write(iter([*records.to_batches(), pa.RecordBatch.from_pylist([inner], records.schema)]))])
    raw = b"".join(gzip.open(f).read() for f in path.iterdir() if f.name.endswith(".gz"))
    foreign(raw, "x.warc", tmp_path / "plain")
    foreign(raw, "x.warc.gz", tmp_path / "foreign")
    names = [n.split(" ")[0] for n in warc.SCHEMA.split(", ")]
    key = lambda rows: sorted(rows, key=repr)
    for folder in (path, tmp_path / "plain", tmp_path / "foreign"):
        for size in (1 << 30, 3000, 500):
            reader = warc.WarcReader(str(folder), type("S", (), {"fields": [type("F", (), {"name": n}) for n in names]}), size)
            parts = reader.partitions()
            assert (len(parts) == 1) == (size == 1 << 30)
            got = key(r for p in parts for r in reader.read(p))
            want = got if size == 1 << 30 and folder == path else want  # noqa: F821
            assert got == want and len(got) == len(pages()) + 1


def test_predicates_reach_the_source_and_spare_payloads(spark, tmp_path):
    """One record's payload is damaged: reads fail where they decode it, and only there."""
    warc.register(spark)
    path = tmp_path / "a"
    r = random.Random(1)
    rows = [(k, f"http://h{k % 2}/{k}", r.randbytes(9000)) for k in range(6)]
    warc.to_records(warc.mark_revisits(spark.createDataFrame(rows, PAGE).coalesce(1))).write.format("warc").mode("append").save(str(path))
    (file,) = [f for f in path.iterdir() if f.name.endswith(".gz")]
    raw = bytearray(file.read_bytes())
    at = 0
    while b"<urn:x-page:3>" not in gzip.decompress(raw[at : at + struct.unpack_from("<I", raw, at + 16)[0]]):
        at += struct.unpack_from("<I", raw, at + 16)[0]
    raw[at + 6000] ^= 255  # in the middle of the payload of record 3
    file.write_bytes(raw)
    read = spark.read.format("warc").load(str(path))
    assert read.where("record_id = '<urn:x-page:2>'").select("payload").first().payload == rows[2][2]
    assert read.where("target_uri like 'http://h0/%'").select(F.sum(F.octet_length("payload")).alias("n")).first().n == 27_000
    assert spark.read.format("warc").schema("record_id string").load(str(path)).count() == 6
    for bad in (read.where("record_id = '<urn:x-page:3>'"), read):
        with pytest.raises(Exception, match="(?i)incorrect|invalid|error"):
            bad.select("payload").collect()
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    reader = warc.WarcReader(str(path), type("S", (), {"fields": []}), 1)
    kept = [GreaterThan(("payload_length",), 5), EqualTo(("content_type",), "x")]
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a", "b")), *kept, StringStartsWith(("target_uri",), "http")])) == kept


def test_no_pages_no_archive(spark, tmp_path):
    warc.register(spark)
    warc.to_records(warc.mark_revisits(spark.createDataFrame([], PAGE))).write.format("warc").mode("append").save(str(tmp_path / "a"))
    assert warc.read_back(spark, str(tmp_path / "a")).count() == 0


# --- SentencePiece ---
def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def small_unigram(squeeze=0, charsmap=b"", inner=False):
    """A hand-made model: unigram scores, byte fallback, white space squeezed or not, with or without a normaliser."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    rows += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -3.5), ("b", -4.0), ("ab", -4.5), ("▁ab", -5.0), ("aba", -5.2), ("é", -6.0), ("ba", -4.8), ("▁a", -4.1), ("fi", -5.5), ("1", -5.0), ("ア", -6.0))]
    rows += [("▁ab▁ab", -6.1, 1)] if inner else []
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in rows)
    model += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"nmt_nfkc" if charsmap else b"identity") + (field(2, charsmap) if charsmap else b"") + field(3, 1) + field(4, squeeze) + field(5, 1))
    return model


def nfkc():
    """The compiled rules that the sentencepiece library brings along, as most models hold them."""
    import sentencepiece

    return dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))[2]


ODD = ["  a  b  ", " ", "\ufb01 \u2460 \uff71", "a b\u3000ab", "A\u0301 e\u0301", "ab\u200bab", "\x00a", "a\r\nb\u2028c", "ab   ab ab", "\u2026\u00bd", "\ufeffab", "e\u0301\u00e9 \uff21\uff42", "     ", "ab\x7f\x01 b"]


@pytest.mark.parametrize("squeeze, mapped, inner", [(0, False, False), (0, True, False), (1, False, True), (1, True, False), (1, True, True)])
def test_unigram_with_a_normaliser(spark, tmp_path, squeeze, mapped, inner):
    """Whole texts against the library, for the query too."""
    import sentencepiece

    raw = small_unigram(squeeze, nfkc() if mapped else b"", inner)
    (tmp_path / "m").write_bytes(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [*TEXTS, *ODD]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pieces.op9_sentencepiece(spark, str(tmp_path), str(tmp_path / "m")).collect()}
    assert all(r.parity for r in got.values())
    for k, t in enumerate(texts):
        want = sp.encode(t or "")
        assert (got[k].n_ids, got[k].ids_sha1) == (len(want), hashlib.sha1(np.array(want, "<u4").tobytes()).hexdigest()), t
    assert got[2].ids_sha1 != hashlib.sha1(b"").hexdigest()


TEXTS = ["", None, "ab abba éab", "x y", "  a  b ", "ab" * 50, "日本 語", "a\nb\tab", "▁ab", "abab abab", "é" * 30, "abab abab"]


def test_unigram_parity_and_round_trip(spark, tmp_path):
    import sentencepiece

    raw = small_unigram()
    (tmp_path / "m").write_bytes(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>").repartition(2)
    got = {r.doc_id: r for r in pieces.encode(df, str(tmp_path / "m")).collect()}
    for k, t in enumerate(TEXTS):
        assert list(got[k].ids) == sp.encode(t or ""), t
        assert got[k].parity


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file here")
@pytest.mark.skipif(not os.path.exists(MODEL) or not os.path.isdir("/root/testdata/sf0.001"), reason="the model or the tables are not here")
def test_no_document_of_the_table_lacks_parity(spark):
    got = pieces.op9_sentencepiece(spark, "/root/testdata/sf0.001").select("parity", "round_trip").distinct().collect()
    assert {r.parity for r in got} == {True}


def test_bpe_parity_and_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*TEXTS, "Hello  world, naïve café \U0001f600 \x00 end", "tabs\tand\nlines " * 200, " lead", "trail "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    ids = pieces.encode(df, MODEL).cache()
    for r in ids.collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id] or "") and r.parity
    back = {r.doc_id: r.text for r in pieces.decode(ids, MODEL).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t in enumerate(texts)}
    digest = {r.doc_id: r for r in pieces.encode(df, MODEL, digest=True).collect()}
    for k, t in enumerate(texts):
        assert digest[k].round_trip == ("▁" not in (t or ""))
        assert digest[k].ids_sha1 == hashlib.sha1(np.array(sp.encode(t or ""), "<u4").tobytes()).hexdigest()
    assert pieces.encode(df.where("false"), MODEL).count() == 0
