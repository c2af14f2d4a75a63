"""Benchmark decontamination by an FM-index for each shard of the training documents.

A shard is a block of documents. Its words are numbered, the suffixes of its word string are sorted (groups of equal
prefixes are refined, each round at three times the depth), and the shard keeps the Burrows-Wheeler string as a wavelet
matrix, the text position of every SAMPLE-th suffix, and where the words lie. The index is a written table, which can be
searched again and again.

A benchmark item gives its windows of `size` consecutive words; an item of fewer words is one window. All distinct
windows of a chunk of the benchmark are searched at once, last word first, by two ranks for each word; occurrences are
located by steps back to the next sampled suffix, and the words that lie in any of them are merged to removal spans.
The benchmark is read in chunks of at most CHUNK_BYTES of text and CHUNK_WORDS words (long items are cut where windows
begin), so that what a pass broadcasts is bounded; each pass reads the index again and a document's spans and items are
united afterwards.

Defined cases: null and empty texts, and those without a word, have no words and are never hit; a null item id hits words
but is not listed; items that share an id are each searched and listed once; repeated documents are rows of their own;
without items nothing is hit; other columns, whatever their names, play no part, and stay untouched in `clean`; a text
larger than a block is a shard of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.llm.common import block_id, blocks, column, documents, flat_text, gaps, give_back, named, pack, row_ids, runs_of, stash, unpack

#: Words of a window; every so many suffixes' positions are kept; text and words of the items that are searched at once.
SIZE, SAMPLE, CHUNK_BYTES, CHUNK_WORDS = 10, 8, 4 << 20, 1 << 19
#: ASCII digits and letters and all longer characters belong to words.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
#: Rows located, and pairs of documents and items made, at once.
SLICE = 1 << 18


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, their first bytes and lengths, words of each text, first bytes of the texts."""
    raw, at = flat_text(texts)
    body = np.frombuffer(raw.translate(FOLD), np.uint8)
    full = np.zeros(len(body) + 2, bool)
    full[1:-1] = body != 32
    cut = np.zeros(len(body) + 1, bool)
    cut[at] = True
    starts = np.nonzero(full[1:] & (~full[:-1] | cut))[0]
    ends = np.nonzero(full[:-1] & (~full[1:] | cut))[0]
    size = ends - starts
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(body[full[1:-1]]))
    return words, starts, size, np.diff(np.searchsorted(starts, at)), at[:-1]


def joined(words: pa.Array) -> bytes:
    """Words have no blanks."""
    return " ".join(words.to_pylist()).encode()


def parted(body: bytes) -> pa.Array:
    return pa.array(body.decode().split(" ") if body else [], pa.large_string())


# --- one shard -------------------------------------------------------------------------------------------------------
def suffix_ranks(t: np.ndarray) -> np.ndarray:
    """The rank of each suffix. The last symbol is 0 and occurs once."""
    n = len(t)
    wide = max(1, int(t.max()).bit_length())
    depth = max(1, 63 // wide)
    padded = np.concatenate([t.astype(np.int64), np.zeros(depth, np.int64)])
    key = padded[:n].copy()
    for k in range(1, depth):
        key <<= wide
        key |= padded[k : n + k]
    live, rank = np.arange(n), np.zeros(n, np.int64)
    bits = n.bit_length()
    times = 3 if 3 * bits <= 63 else 2
    while len(live):
        order = np.argsort(key)
        live, key = live[order], key[order]
        place, old = np.arange(len(live)), rank[live]  # a group is ranked by the place of its first
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, place, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank[live] = old + first - group
        alone = new & np.concatenate([new[1:], [True]])
        live = live[~alone]
        key = rank[live]
        for k in range(1, times):
            key = key << bits | rank[np.minimum(live + k * depth, n - 1)]
        depth *= times
    return rank


class Bits:
    """A bit string with ranks."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        counts = np.bitwise_count(packed)
        self.before = np.cumsum(counts, dtype=np.int64) - counts

    @staticmethod
    def packed_of(flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
        some = np.packbits(flags, bitorder="little")
        out[: len(some)] = some
        return out.view("<u8")

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many bits before i are set."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.packed[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


def built(ids: np.ndarray, n_words: np.ndarray, sigma: int) -> dict[str, np.ndarray]:
    """The index of documents of so many words each. Symbols: 0 ends the shard, 1 a document, words follow."""
    n = len(ids) + len(n_words) + 1
    t = np.ones(n, np.int64)
    t[-1] = 0
    body = np.ones(n, bool)
    body[np.append(np.cumsum(n_words + 1) - 1, n - 1)] = False
    t[body] = ids + 2
    rank = suffix_ranks(t)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    x = t[order - 1].astype(np.uint32)
    levels, zeros = [], []
    for level in reversed(range(max(1, (sigma + 1).bit_length()))):
        one = (x >> np.uint32(level) & np.uint32(1)).astype(bool)
        levels.append(Bits.packed_of(one))
        zeros.append(n - int(one.sum()))
        x = np.concatenate([x[~one], x[one]])
    marks = order % SAMPLE == 0
    return {"levels": np.concatenate(levels), "zeros": np.array(zeros), "freq": np.bincount(t, minlength=sigma + 2), "marks": Bits.packed_of(marks), "samples": order[marks] // SAMPLE}


class Shard:
    def __init__(self, body: dict[str, np.ndarray]):
        self.freq = body["freq"].astype(np.int64)
        self.first = np.cumsum(self.freq) - self.freq
        self.zeros = body["zeros"].astype(np.int64).tolist()
        self.levels = [Bits(x) for x in np.split(body["levels"].astype(np.uint64), len(self.zeros))]
        self.marks, self.samples = Bits(body["marks"].astype(np.uint64)), body["samples"].astype(np.int64)
        every = np.arange(len(self.freq))
        self.shift = self.first - self.down(every, np.zeros(len(every), np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i symbols' occurrences of a symbol end at the foot of the matrix."""
        for k, (bits, zero) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = bits.ones(i)
            i = np.where(symbol >> (len(self.zeros) - 1 - k) & 1, zero + one, i - one)
        return i

    def back(self, i: np.ndarray) -> np.ndarray:
        """The rank of the suffix that begins one symbol earlier."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zero in zip(self.levels, self.zeros, strict=True):
            bit, one = bits.at(i), bits.ones(i)
            i = np.where(bit, zero + one, i - one)
            symbol = symbol << 1 | bit
        return i + self.shift[symbol]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of the suffixes that begin with each window (rows of symbols, of so many each)."""
        last = symbols[np.arange(len(length)), length - 1]
        low, high = self.first[last], self.first[last] + self.freq[last]
        live = np.nonzero((low < high) & (length > 1))[0]
        step = 2
        while len(live):
            c = symbols[live, length[live] - step]
            ends = self.down(np.tile(c, 2), np.concatenate([low[live], high[live]])) + np.tile(self.shift[c], 2)
            low[live], high[live] = ends[: len(live)], ends[len(live) :]
            live = live[(low[live] < high[live]) & (length[live] > step)]
            step += 1
        return low, high - low

    def locate(self, rank: np.ndarray) -> np.ndarray:
        out, live, steps = np.empty(len(rank), np.int64), np.arange(len(rank)), 0
        while len(live):
            known = self.marks.at(rank)
            out[live[known]] = self.samples[self.marks.ones(rank[known])] * SAMPLE + steps
            live, rank = live[~known], self.back(rank[~known])
            steps += 1
        return out


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges written out: which range, and each of its numbers."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]


def slices(count: np.ndarray, most: int):
    """Runs of entries whose counts add up to `most`, or single ones above."""
    for _, i, j in runs_of((np.cumsum(count) - count) // most):
        yield i, j


# --- tables ----------------------------------------------------------------------------------------------------------
def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with one row for each shard: block, ids, body, words."""
    ids = docs.schema[doc_id].dataType

    def build(batches):
        for k, t in enumerate(blocks(batches)):
            words, starts, size, n_words, at = tokens(column(t, "text"))
            coded = words.dictionary_encode()
            body = built(coded.indices.to_numpy().astype(np.int64), n_words, len(coded.dictionary))
            body |= {"n_words": n_words, "starts": gaps(starts), "size": size, "at": gaps(at)}
            ids = column(t, "id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_id(k)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([pack(**body)], pa.binary()), pa.array([joined(coded.dictionary)], pa.binary())],
                names=["block", "ids", "body", "words"],
            )
            del words, coded, body
            give_back()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(ids)), T.StructField("body", T.BinaryType()), T.StructField("words", T.BinaryType())])
    return stash(docs.select(named(doc_id).alias("id"), named(text).alias("text")).mapInArrow(build, schema))


def windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """Chunks of bounded size: distinct windows, the items of each."""

    def cut(batches):
        for t in blocks(batches, CHUNK_BYTES):
            words, _, _, n_words, _ = tokens(column(t, "text"))
            coded = words.dictionary_encode()
            ids, names = coded.indices.to_numpy().astype(np.int64), column(t, "item")
            item, begin = spread(np.cumsum(n_words) - n_words, np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0))
            length = np.minimum(n_words[item], size)
            for i in range(0, len(ids), CHUNK_WORDS):
                some = (begin >= i) & (begin < i + CHUNK_WORDS)
                at = begin[some, None] + np.arange(size)
                flat = np.where(np.arange(size) < length[some, None], ids[np.minimum(at, len(ids) - 1)], -1)
                kinds, kind = np.unique(flat, axis=0, return_inverse=True)
                pairs = np.unique(kind.ravel() * len(names) + item[some])
                pairs = pairs[np.asarray(names.is_valid().to_numpy(zero_copy_only=False))[pairs % len(names)]]
                used, ids_used = np.unique(kinds, return_inverse=True)
                less = int((used[:1] < 0).sum())  # -1 fills short windows
                body = pack(ids=ids_used.ravel() - less, length=(kinds >= 0).sum(1), items=np.bincount(pairs // len(names), minlength=len(kinds)), item=pairs % len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([body], pa.binary()), pa.array([joined(coded.dictionary.take(pa.array(used[less:])))], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)],
                    names=["body", "words", "names"],
                )

    total = items.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0
    source = items.select(named(item_id).cast("string").alias("item"), named(text).alias("text")).coalesce(int(total // CHUNK_BYTES) + 1)
    return stash(source.mapInArrow(cut, "body binary, words binary, names array<string>"))


class Windows:
    def __init__(self, body: bytes, words: bytes, names: list, size: int):
        x = unpack(body)
        self.length = x["length"].astype(np.int64)
        self.ids = x["ids"].astype(np.int64).reshape(-1, size)
        self.n_items, self.item = x["items"].astype(np.int64), x["item"].astype(np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items
        self.words, self.names, self.size = parted(words), pa.array(names, pa.string()), size

    def found(self, shard: Shard, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First ranks and numbers of the occurrences of those windows that occur, and which they are."""
        number = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy().astype(np.int64) if len(self.words) else np.empty(0, np.int64)
        symbols = np.where(np.arange(self.size) < self.length[:, None], number[np.maximum(self.ids, 0)], 0) if len(number) else np.zeros((0, self.size), np.int64)
        some = np.nonzero((symbols >= 0).all(1))[0]
        low, count = shard.search(symbols[some] + 2, self.length[some])
        on = count > 0
        return low[on], count[on], some[on]


SPANS = "row long, doc_id {}, n_words long, spans array<struct<begin:int,end:int,from_byte:long,to_byte:long>>, items array<string>"


def searcher(chunk, size: int):
    def search(batches):
        w = Windows(*chunk.value, size)
        for batch in batches:
            for k in range(batch.num_rows):
                yield searched(w, batch.column(0)[k].as_py(), batch.column(1).slice(k, 1).flatten(), unpack(batch.column(2)[k].as_py()), parted(batch.column(3)[k].as_py()))
                give_back()

    return search


def searched(w: Windows, block: int, ids: pa.Array, body: dict[str, np.ndarray], words: pa.Array) -> pa.RecordBatch:
    n_words = body["n_words"].astype(np.int64)
    shard = Shard(body)
    low, count, which = w.found(shard, words)
    begin = np.cumsum(n_words + 1) - (n_words + 1)
    change = np.zeros(int((n_words + 1).sum()) + 2, np.int32)
    seen = [np.empty(0, np.int64)]
    for i, j in slices(count, SLICE):  # equal windows are one, so that occurrences are at most `size` for each word
        one, rank = spread(low[i:j], count[i:j])
        for k in range(0, len(rank), SLICE):
            window = which[i:j][one[k : k + SLICE]]
            at = shard.locate(rank[k : k + SLICE])
            np.add.at(change, at, 1)
            np.add.at(change, at + w.length[window], -1)
            seen.append(np.unique((np.searchsorted(begin, at, side="right") - 1) * len(w.length) + window))
    hit = np.cumsum(change)[:-1] > 0
    first = np.nonzero(hit & ~np.concatenate([[False], hit[:-1]]))[0]
    end = np.nonzero(hit & ~np.concatenate([hit[1:], [False]]))[0] + 1
    doc = np.searchsorted(begin, first, side="right") - 1
    starts = np.cumsum(body["starts"].astype(np.int64))
    text_at = np.cumsum(body["at"].astype(np.int64))
    from_byte = starts[first - doc] - text_at[doc]
    to_byte = starts[end - 1 - doc] + body["size"][end - 1 - doc].astype(np.int64) - text_at[doc]
    spans = pa.StructArray.from_arrays([pa.array((x - begin[doc]).astype(np.int32)) for x in (first, end)] + [pa.array(from_byte), pa.array(to_byte)], ["begin", "end", "from_byte", "to_byte"])
    pairs = np.unique(np.concatenate(seen))
    in_doc, window = pairs // max(1, len(w.length)), pairs % max(1, len(w.length))
    found = [np.empty(0, np.int64)]
    for i, j in slices(w.n_items[window], 16 * SLICE):
        one, at = spread(w.first_item[window[i:j]], w.n_items[window[i:j]])
        found.append(np.unique(in_doc[i:j][one] * len(w.names) + w.item[at]))
    found = np.unique(np.concatenate(found))
    cuts = lambda x: pa.array(np.searchsorted(x, np.arange(len(n_words) + 1)).astype(np.int32))
    items = pa.ListArray.from_arrays(cuts(found // max(1, len(w.names))), w.names.take(pa.array(found % max(1, len(w.names)))))
    return pa.RecordBatch.from_arrays([pa.array(row_ids(block, len(n_words))), ids, pa.array(n_words), pa.ListArray.from_arrays(cuts(doc), spans), items], names=["row", "doc_id", "n_words", "spans", "items"])


def merged(spans):
    """Spans of several passes as one list of disjoint ones; a span's last byte goes with its end."""

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"), last["from_byte"].alias("from_byte"), F.greatest(last["to_byte"], x["to_byte"]).alias("to_byte"))
        return F.when((F.size(acc) > 0) & (last["end"] >= x["begin"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<begin:int,end:int,from_byte:long,to_byte:long>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def find(shards: DataFrame, items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For each document of an index: row, doc_id, n_words, spans of hit words (with their bytes), items (sorted)."""
    session = shards.sparkSession
    schema = SPANS.format(shards.schema["ids"].dataType.elementType.simpleString())
    chunks = windows(items, size, item_id, text).toLocalIterator()
    searched_for = lambda chunk: shards.mapInArrow(searcher(session.sparkContext.broadcast(chunk), size), schema)
    none = np.empty(0, np.int64)
    passes = [searched_for(tuple(c)) for c in chunks] or [searched_for((pack(ids=none, length=none, items=none, item=none), b"", []))]
    out = reduce(DataFrame.unionByName, passes)
    if len(passes) > 1:
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, without the words that are hit and what stands between them."""
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*map(named, docs.columns)).alias("doc")))
    shards = index(rows.select("row", F.col("doc").getField(text).alias("text")), "row", "text")
    found = find(shards, items, size).where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
    raw = F.encode(F.col("doc").getField(text), "utf-8")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.to_byte"))
    ends = F.concat(F.col("spans.from_byte"), F.array(F.octet_length(raw).cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.decode(F.substring(raw, (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")), "utf-8"))
    left = F.when(F.col("spans").isNull(), F.col("doc").getField(text)).otherwise(F.array_join(pieces, ""))
    return rows.join(found, "row", "left").select(*[(left if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(index(documents(spark, sf_dir)), documents(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = rf"""
with fold as (select doc_id as id, 0 as kind, text from documents union all select item_id, 1, text from benchmark),
t as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from fold),
d as (select id as doc_id, w, len(w)::bigint as n from t where kind = 0),
b as (select id as item_id, w, len(w) as n from t where kind = 1 and len(w) > 0),
bw as (select distinct item_id, least(n, {SIZE}) as m, array_to_string(w[i : i + least(n, {SIZE}) - 1], ' ') as p
  from (select *, unnest(range(1, greatest(n - {SIZE} + 1, 1) + 1)) as i from b)),
m as (select distinct m from bw),
dw as (select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as p from (select d.doc_id, d.w, d.n, m.m, unnest(range(1, d.n - m.m + 2)) as i from d, m where d.n >= m.m)),
occ as (select dw.doc_id, dw.i, dw.m, dw.p from dw where p in (select p from bw)),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + m)) as k from occ) group by doc_id),
it as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as s from (select distinct occ.doc_id, bw.item_id from occ join bw on occ.p = bw.p and occ.m = bw.m) group by doc_id)
select d.doc_id, d.n as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items, sha256(coalesce(it.s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
QUERIES = {"op11_fm_index": op11_fm_index}
ORACLES = {"op11_fm_index": ORACLE}
