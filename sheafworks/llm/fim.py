"""Fill-in-middle transformation: documents are cut at line ends into prefix, middle and suffix, and put in another order.

Texts are split into content-defined chunks: a chunk ends where the rolling hash of the last WINDOW bytes has MASK's bits
unset, LEAST bytes after its start or later, MOST bytes at the latest. What a chunk contributes to any text is kept in a
cache of the task: its line ends, its code points, whether it holds a mark, and its first and last bytes, with which a mark
that lies across a boundary is found. A chunk that other texts share is looked up by its hash and held against the cached
bytes before its counts are taken. Counts are added up chunk by chunk; only the chunk in which a cut falls is looked into.
The cache holds CACHE bytes and forgets the least recently used chunks, which costs time and never a result.

Cuts, form and order depend on the seed and the id alone, so that a lost task gives the same rows again. Texts go through
one narrow pass in Arrow batches: nothing is shuffled.

Defined cases: null and empty texts are plain and empty; a null id counts as the empty string; rows that share an id and
equal texts get equal results; a text that holds a mark is plain; other columns, whatever their names, play no part, and
stay untouched in `transform`; an empty table gives an empty result; a text of any length is one row, whose chunks are
bounded.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.llm.common import blocks, column, documents, flat_text, named

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Seed of the draws, texts in a hundred that are transformed, and of these the suffix-first ones.
PARAMS = {"seed": 7, "rate": 100, "spm": 50}
#: Rolling window; a chunk's shortest, usual (2 ** 11 more) and longest size; bytes that a task's cache holds.
WINDOW, LEAST, MASK, MOST, CACHE = 32, 512, (1 << 11) - 1, 16_384, 32 << 20
GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint32)
BYTES = tuple(m.encode() for m in MARKS)
NEWLINE = 10


def rolling(raw: np.ndarray) -> np.ndarray:
    """For each place the hash of the WINDOW bytes that end there: each older byte's value is shifted once more."""
    h, span = GEAR[raw], 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is computed before it is added
        span *= 2
    return h


def boundaries(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """The ends of each text's chunks. They depend on the text alone."""
    top = np.uint32(MASK << 16)  # higher bits have met more bytes
    some = np.nonzero(rolling(raw) & top == 0)[0] + 1 if len(raw) else np.empty(0, np.int64)
    edge = np.searchsorted(some, at, side="right")
    out = []
    for k in range(len(at) - 1):
        start, end = int(at[k]), int(at[k + 1])
        last, ends = start, []
        for place in [*some[edge[k] : edge[k + 1]].tolist(), end]:
            while place - last > MOST:
                last += MOST
                ends.append(last)
            if place - last >= LEAST and place - start >= WINDOW and place < end:
                ends.append(place)
                last = place
        if end > last:
            ends.append(end)
        out.append(ends)
    return out


class Chunk:
    """What a chunk adds to a text."""

    __slots__ = ("body", "lines", "points", "marked")

    def __init__(self, body: bytes):
        raw = np.frombuffer(body, np.uint8)
        self.body = body
        self.lines = np.nonzero(raw == NEWLINE)[0] + 1
        self.points = len(body) - int(np.count_nonzero(raw & 0xC0 == 0x80))  # continuation bytes are no code points
        self.marked = any(m in body for m in BYTES)


class Chunks:
    """A cache of chunks by content."""

    def __init__(self, room: int = CACHE):
        self.room, self.used, self.kept, self.hits = room, 0, OrderedDict(), 0

    def get(self, body: bytes) -> Chunk:
        key = hash(body)
        chunk = self.kept.get(key)
        if chunk is not None and chunk.body == body:
            self.hits += 1
            self.kept.move_to_end(key)
            return chunk
        if chunk is not None:  # another content of the same hash gives way
            self.used -= len(self.kept.pop(key).body)
        chunk = self.kept[key] = Chunk(body)
        self.used += len(body)
        while self.used > self.room and len(self.kept) > 1:
            self.used -= len(self.kept.popitem(last=False)[1].body)
        return chunk


class Cut:
    """A text as its chunks, with running counts."""

    def __init__(self, body: bytes, ends: list[int], cache: Chunks):
        self.size = len(body)
        self.starts = [0, *ends][: len(ends)]
        self.chunks = [cache.get(body[s:e]) for s, e in zip(self.starts, ends, strict=True)]
        self.lines = np.cumsum([0, *(len(c.lines) for c in self.chunks)])
        self.points = np.cumsum([0, *(c.points for c in self.chunks)])
        self.units = int(self.lines[-1]) + (self.size > 0 and body[-1] != NEWLINE)
        self.marked, tail = any(c.marked for c in self.chunks), b""
        for c in self.chunks:
            seam = tail + c.body[:2]
            self.marked = self.marked or any(m in seam for m in BYTES)
            tail = (tail + c.body)[-2:] if len(c.body) < 2 else c.body[-2:]

    def place(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which so many units end."""
        if unit > self.lines[-1]:
            return self.size, int(self.points[-1])
        if unit == 0:
            return 0, 0
        k = int(np.searchsorted(self.lines, unit)) - 1
        chunk = self.chunks[k]
        off = int(chunk.lines[unit - self.lines[k] - 1])
        raw = np.frombuffer(chunk.body, np.uint8, off)
        return self.starts[k] + off, int(self.points[k]) + off - int(np.count_nonzero(raw & 0xC0 == 0x80))


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers of 32 bits for each id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformer(seed: int, rate: int, spm: int):
    p, s, m = BYTES

    def one(body: bytes, ends: list[int], doc_id, cache: Chunks) -> tuple:
        cut = Cut(body, ends, cache)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not body or cut.marked or h3 % 100 >= rate:
            return cut.units, "plain", None, None, body
        low, high = sorted((h1 % (cut.units + 1), h2 % (cut.units + 1)))
        (i, a), (j, b) = cut.place(low), cut.place(high)
        first, middle, last = body[:i], body[i:j], body[j:]
        if h4 % 100 < spm:
            return cut.units, "spm", a, b - a, b"".join((s, last, p, first, m, middle))
        return cut.units, "psm", a, b - a, b"".join((p, first, s, last, m, middle))

    def transform(batches):
        cache = Chunks()
        for t in blocks(batches):
            raw, at = flat_text(column(t, "text"))
            ends = boundaries(np.frombuffer(raw, np.uint8), at)
            ids = column(t, "id").to_pylist()
            rows = [one(raw[b:e], [x - b for x in ends[k]], ids[k], cache) for k, (b, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
            n, form, prefix, middle, out = zip(*rows, strict=True)
            made = pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([x.decode() for x in out], pa.string())],
                ["n", "form", "prefix_chars", "middle_chars", "output"],
            )
            yield from pa.table({"rest": t.column("rest"), "fim": made}).to_batches()

    return transform


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: list[str] | None = None, **params) -> DataFrame:
    """rest: a struct of the documents' columns (of those named, if any); fim: n, form, prefix_chars, middle_chars, output."""
    whole = F.struct(*[named(c) for c in (docs.columns if rest is None else rest)])
    source = docs.select(named(doc_id).cast("string").alias("id"), named(text).alias("text"), whole.alias("rest"))
    fim = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return source.mapInArrow(transformer(**(PARAMS | params)), T.StructType([source.schema["rest"], T.StructField("fim", fim)]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; marks stand where the form puts them, since no transformed text holds one."""
    parts = F.split(output, "|".join(MARKS), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_chunk_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(documents(spark, sf_dir), rest=["doc_id"]).select("rest.doc_id", "fim.*")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('{PARAMS["seed"]}:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, text, u, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {PARAMS["rate"]} then 'plain' when h4 % 100 < {PARAMS["spm"]} then 'spm' else 'psm' end as form from x),
p as (select *, array_to_string(u[1 : i], '') as prefix, array_to_string(u[i + 1 : j], '') as middle, array_to_string(u[j + 1 : n], '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
QUERIES = {"op12_chunk_memo": op12_chunk_memo}
ORACLES = {"op12_chunk_memo": ORACLE}
