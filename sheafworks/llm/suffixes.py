"""Exact substring dedup over suffix arrays of content-partitioned shards.

Every byte that lies in a string of `length` bytes which also starts earlier (smaller id, or earlier in the document)
is removed. Each window of that length has an anchor: of its grams of half the length the one with the least hash,
which depends on the window's bytes only. Equal windows thus have equal anchors, so that windows can be dealt to
shards by their anchor. Blocks of documents first ask which anchors occur twice anywhere; the others' windows are
unique. The pieces of text around the rest go, packed, to the shard of their anchor, equal pieces once. A shard sorts
the suffixes of those pieces whose anchor has several different pieces: suffixes are classified, the leftmost-smaller
ones sorted by induction from their substrings and the shard array induced from them in linear passes, a bucket at a
time; the string of their names is sorted by the same procedure, its substrings a symbol at a time, until all names
differ; common prefixes come in text order from the permuted array, computed at irreducible positions only. Windows
with a common prefix of `length` or more are equal; all but the first are removed.

An anchor that more than HOT runs of windows have, as one within a frequent line has, would make one shard's share grow
with the corpus. Its windows are dealt one by one by a hash of 128 bits of the whole window, each once for each block.

Defined cases: null texts are empty; documents shorter than `length` stay as they are; a null id comes after all
others; rows that repeat an id are told apart by their place in the input; ties cannot occur otherwise; other columns,
whatever their names, go through `strip` untouched; empty in, empty out; a text larger than a block is a block of its
own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.llm.common import BLOCK_BYTES, block_id, blocks, column, count_parts, documents, flat_text, gaps, named, pack, part_of, runs_of, stash, trim, unpack
from sheafworks.llm.jaccard import mix

LENGTH = 100
LAST = np.iinfo(np.int64).max
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).view(np.uint64) | np.uint64(1)
CHUNK, BATCH = 1 << 20, 1 << 20
#: Runs of windows with one anchor that one shard takes.
HOT = 50_000


# --- anchors ---------------------------------------------------------------------------------------------------------
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and PRIME**-i modulo 2**64."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    out = []
    for base in (PRIME, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(raw: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Two hashes of the windows that begin at these places, which ascend."""
    out, i = [np.empty(len(at), np.uint64) for _ in range(2)], 0
    up, down = powers(CHUNK + length)
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + CHUNK))
        some = raw[at[i] : at[j - 1] + length]
        for x, values in zip(out, (VALUES, mix(VALUES, 1) | np.uint64(1)), strict=True):
            x[i:j] = gram_hashes(some, length, up, down, values)[at[i:j] - at[i]]
        i = j
    return out


def anchors_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """For runs of windows with one anchor: first window, number of windows, hash of the anchor. By text order."""
    gram = length // 2
    wide = length - gram + 1
    out: list[tuple] = []
    k, longest = 0, max([CHUNK, *size.tolist()])
    up, down = powers(longest)
    while k < len(size):
        m = k + 1
        while m < len(size) and start[m] + size[m] - start[k] <= CHUNK:
            m += 1
        lo, hi = int(start[k]), int(start[m - 1] + size[m - 1])
        if hi - lo >= length:
            h = gram_hashes(raw[lo:hi], gram, up, down)
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= wide:
                low = np.minimum(low[: len(low) - span], low[span:])
                span *= 2
            if span < wide:
                low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
            at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of window s, for all s
            ok = np.zeros(len(at) + 1, np.int64)
            for s, n in zip((start[k:m] - lo).tolist(), size[k:m].tolist(), strict=True):
                if n >= length:
                    ok[s] += 1
                    ok[s + n - length + 1] -= 1
            s = np.nonzero(np.cumsum(ok)[:-1])[0]
            a = at[s]
            new = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))[0] if len(s) else s
            # hashes of minima are small ones: mixed again, ranges of them hold equal shares
            out.append((s[new] + lo, np.diff(np.append(new, len(s))), mix(h[a[new]], 4)))
        k = m
    names = ("s", "w", "h")
    kinds = (np.int64, np.int64, np.uint64)
    return {n: np.concatenate([np.empty(0, kind), *(x[i] for x in out)]).astype(kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))}


# --- suffix arrays ---------------------------------------------------------------------------------------------------
def induce(t: np.ndarray, larger: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order (seeds): larger ones from the left, smaller from the right.

    A bucket's entries are handled together; those that they put into their own bucket are the next wave.
    """
    n = len(t)
    sa = np.full(n, -1, np.int64)
    sizes = np.bincount(t, minlength=sigma)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n_large = np.bincount(t[larger], minlength=sigma)
    seed_cut = np.concatenate([[0], np.cumsum(np.bincount(t[seeds], minlength=sigma))])
    # seeds are in order of their first character, being sorted
    head = begin[:-1].copy()

    def put(pred: np.ndarray, at: np.ndarray, step: int) -> None:
        c = t[pred]
        order = np.argsort(c, kind="stable")
        pred, c = pred[order], c[order]
        edge = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0]
        n_each = np.diff(np.append(edge, len(c)))
        offset = np.arange(len(c)) - np.repeat(edge, n_each)
        sa[at[c] + step * offset] = pred
        at[c[edge]] += step * n_each

    last = n - 1
    if larger[last]:  # the end counts as smaller than everything
        sa[head[t[last]]] = last
        head[t[last]] += 1
    for c in np.nonzero(sizes)[0]:
        done = begin[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            pred = wave[wave > 0] - 1
            pred = pred[larger[pred]]
            if len(pred):
                put(pred, head, 1)
        wave = seeds[seed_cut[c] : seed_cut[c + 1]]
        pred = wave[wave > 0] - 1
        pred = pred[larger[pred]]
        if len(pred):
            put(pred, head, 1)
    tail = begin[1:] - 1
    for c in np.nonzero(sizes)[0][::-1]:
        done = begin[c + 1] - 1
        while done > tail[c]:
            wave, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
            pred = wave[wave > 0] - 1
            pred = pred[~larger[pred]]
            if len(pred):
                put(pred, tail, -1)
        wave = sa[begin[c] : begin[c] + n_large[c]][::-1]
        pred = wave[wave > 0] - 1
        pred = pred[~larger[pred]]
        if len(pred):
            put(pred, tail, -1)
    return sa


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are larger than the next one, and the leftmost-smaller positions."""
    n = len(t)
    differs = np.nonzero(t[1:] != t[:-1])[0]
    nearest = np.full(n, n - 1)
    nearest[: n - 1] = np.concatenate([differs, [n - 1]])[np.searchsorted(differs, np.arange(n - 1))]
    follow = np.minimum(nearest + 1, n - 1)
    larger = np.where(nearest == n - 1, True, t[nearest] > t[follow])
    small = ~larger
    lms = np.nonzero(small[1:] & larger[:-1])[0] + 1
    return larger, lms


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting; the reduced string of names is sorted by the same procedure."""
    n, sigma = len(t), int(t.max()) + 1
    larger, lms = classify(t)
    if not len(lms):
        return induce(t, larger, lms, sigma)
    rough = induce(t, larger, lms[np.argsort(t[lms], kind="stable")], sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    k = place[order]  # number of each leftmost-smaller suffix, in order of its substring
    end = np.append(lms[1:], n - 1)
    size = end[k] - order + 1
    same = np.concatenate([[False], size[1:] == size[:-1]])
    live, off = np.nonzero(same)[0], 0
    while len(live):
        equal = t[order[live] + off] == t[order[live - 1] + off]
        same[live[~equal]] = False
        off += 1
        live = live[equal]
        live = live[size[live] > off]
    names = np.empty(len(lms), np.int64)
    names[k] = np.cumsum(~same) - 1
    if names.max() == len(lms) - 1:
        return induce(t, larger, order, sigma)
    return induce(t, larger, lms[sorted_names(names)], sigma)


def named_substrings(t: np.ndarray, larger: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in their order, equal ones alike.

    They are sorted a symbol and class at a time, only those that are still alike at each step. With classes none begins
    another one, but for the last, which the end of the string, smaller than all symbols, tells apart."""
    n = len(t)
    key = np.append(2 * t.astype(np.int64) + ~larger, -1)
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    order = np.argsort(key[lms], kind="stable")
    first = key[lms[order]]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    at, off = np.arange(len(lms)), 1
    while True:
        group = np.cumsum(new[at]) - 1
        keep = (np.bincount(group)[group] > 1) & (size[order[at]] > off) if len(at) else np.zeros(0, bool)
        at, group = at[keep], group[keep]
        if not len(at):
            break
        some = order[at]
        k = group * (int(key.max()) + 2) + key[lms[some] + off] + 1
        o = np.argsort(k, kind="stable")
        order[at], k = some[o], k[o]
        new[at[1:][k[1:] != k[:-1]]] = True
        off += 1
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    return names


def sorted_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names. They are many and each rare, so that plain passes take the place of bucketwise ones."""
    n = len(t)
    larger, lms = classify(t)
    s, sigma, down = t.tolist(), int(t.max()) + 1, larger.tolist()
    ends = np.cumsum(np.bincount(t, minlength=sigma))

    def induced(seeds: list[int]) -> list[int]:
        sa, tail = [-1] * n, ends.tolist()
        for i in reversed(seeds):
            tail[s[i]] -= 1
            sa[tail[s[i]]] = i
        head = [0, *ends[:-1].tolist()]
        if down[n - 1]:
            sa[head[s[n - 1]]] = n - 1
            head[s[n - 1]] += 1
        for k in range(n):
            i = sa[k] - 1
            if i >= 0 and down[i]:
                sa[head[s[i]]] = i
                head[s[i]] += 1
        tail = ends.tolist()
        for k in range(n - 1, -1, -1):
            i = sa[k] - 1
            if i >= 0 and not down[i]:
                tail[s[i]] -= 1
                sa[tail[s[i]]] = i
        return sa

    if not len(lms):
        return np.array(induced([]), np.int64)
    names = named_substrings(t, larger, lms)
    order = np.argsort(names) if names.max() == len(lms) - 1 else sorted_names(names)
    return np.array(induced(lms[order].tolist()), np.int64)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of sa the common prefix with the one before, from the permuted array in text order."""
    n = len(t)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    ahead = np.zeros(n, bool)
    i = np.arange(1, n)
    ahead[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (phi[:-1] >= 0) & (t[i - 1] == t[np.maximum(phi[1:], 1) - 1])
    live = np.nonzero(~ahead & (phi >= 0))[0]
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    wide = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    i, j, size = live, phi[live], np.zeros(len(live), np.int64)
    index = np.arange(len(live))
    final = np.zeros(len(live), np.int64)
    while len(index):
        a, b = i[index] + size[index], j[index] + size[index]
        x = wide[np.minimum(a, n)] ^ wide[np.minimum(b, n)]
        room = n - np.maximum(a, b)
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        step = np.minimum(step, np.maximum(room, 0))
        size[index] += step
        final[index] = size[index]
        index = index[step == 8]
    plcp[live] = final
    base = np.maximum.accumulate(np.where(~ahead, np.arange(n), -1))
    plcp = np.where(ahead, plcp[base] - (np.arange(n) - base), plcp)
    return plcp[sa]


def repeated_windows(pieces: list[bytes], order: np.ndarray, begins: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows also occur earlier. order: rank of the document, begins: start in it."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int((size + 1).sum())
    t = np.zeros(n, np.int16)
    start = np.cumsum(size + 1) - (size + 1)
    body = np.ones(n, bool)
    body[start + size] = False
    t[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + 1
    used, t = np.unique(t, return_inverse=True)  # at most 257 values, 0 parts the pieces
    sa = suffix_array(t)
    lcp = common_prefixes_wide(t, sa, len(used))
    group = np.cumsum(lcp < length)
    which = np.searchsorted(start, sa, side="right") - 1
    off = sa - start[which]
    ok = off + length <= size[which]
    which, off, group = which[ok], off[ok], group[ok]
    when = (order[which] << 32) + begins[which] + off
    edge = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0] if len(group) else group
    first = np.repeat(np.minimum.reduceat(when, edge), np.diff(np.append(edge, len(group)))) if len(group) else when
    flags = np.zeros(n, bool)
    flags[start[which] + off] = when > first
    return [flags[s : s + k - length + 1] for s, k in zip(start, size, strict=True)]


def common_prefixes_wide(t: np.ndarray, sa: np.ndarray, sigma: int) -> np.ndarray:
    """common_prefixes where the values may not fit a byte (257 of them): the last two are told apart by a check."""
    if sigma <= 256:
        return common_prefixes(t, sa)
    n = len(t)
    out = np.zeros(n, np.int64)
    i, j, live = sa[1:], sa[:-1], np.arange(n - 1)
    k = 0
    while len(live):
        fits = np.maximum(i[live], j[live]) + k < n
        live = live[fits]
        live = live[t[i[live] + k] == t[j[live] + k]]
        out[live + 1] += 1
        k += 1
    return out


# --- blocks and shards -----------------------------------------------------------------------------------------------
def ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def collect(batches):
    """Blocks: the texts' bytes, where each lies, ids, and the other columns."""
    for k, t in enumerate(blocks(batches, BLOCK_BYTES // 2)):
        raw, at = flat_text(column(t, "text"))
        ids = column(t, "id")
        body = pack(raw=np.frombuffer(raw, np.uint8), size=np.diff(at), ids=ids.fill_null(0).to_numpy().astype(np.int64), null=np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
        rest = ipc(t.select(["rest"]))
        yield pa.RecordBatch.from_arrays([pa.array([block_id(k)], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([body], pa.binary()), pa.array([rest], pa.binary())], names=["block", "bytes", "body", "rest"])


class Block:
    def __init__(self, block: int, body: bytes, length: int, bits: int, parts: int, hot: int):
        b = unpack(body)
        self.raw, self.size = b["raw"], b["size"].astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.where(b["null"].astype(bool), LAST, b["ids"].astype(np.int64))
        self.null = b["null"].astype(bool)
        self.block, self.length, self.bits, self.parts, self.hot = block, length, bits, parts, hot
        self.runs = anchors_of(self.raw, self.start, self.size, length)
        self.short = self.runs["h"] >> np.uint64(64 - bits)
        self.keys, self.count = np.unique(self.short, return_counts=True)
        self.anchor_runs = runs_of(part_of(self.keys, bits, parts))

    def ask_anchors(self):
        for p, i, j in self.anchor_runs:
            yield p, pack(h=gaps(self.keys[i:j]), n=np.minimum(self.count[i:j], self.hot + 1))

    def hot_windows(self, some: np.ndarray) -> None:
        """The windows of these runs; of equal ones the first, by hash."""
        w = self.runs["w"][some]
        at = np.repeat(self.runs["s"][some], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        doc = np.searchsorted(self.start, at, side="right") - 1
        h = window_hashes(self.raw, at, self.length)
        order = np.lexsort((at, doc, self.ids[doc], h[1], h[0]))
        new = np.concatenate([[True], (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])]) if len(at) else np.zeros(0, bool)
        self.again, first = at[order][~new], order[new]
        self.windows = {"at": at[first], "h1": h[0][first], "h2": h[1][first], "doc": doc[first]}
        self.window_runs = runs_of(part_of(self.windows["h1"], 64, self.parts))

    def pieces(self, answers: dict[int, bytes]) -> None:
        """The runs whose anchor occurs twice, equal pieces of text numbered; the first of each kind, by key."""
        often = np.zeros(len(self.keys), np.uint8)
        for p, i, j in self.anchor_runs:
            often[i:j] = unpack(answers[p])["often"]
        often = often[np.searchsorted(self.keys, self.short)]
        self.hot_windows(np.nonzero(often == 2)[0])
        some = np.nonzero(often == 1)[0]
        self.s, self.w, key = self.runs["s"][some], self.runs["w"][some], self.short[some]
        doc = np.searchsorted(self.start, self.s, side="right") - 1
        full = self.size[doc] > 0
        assert full.all()
        n = self.w + self.length - 1
        at = np.concatenate([[0], np.cumsum(n)])
        text = np.empty(at[-1], np.uint8)
        for i in range(0, len(n), 16_384):
            j = min(len(n), i + 16_384)
            text[at[i] : at[j]] = self.raw[np.arange(at[i], at[j]) + np.repeat(self.s[i:j] - at[i:j], n[i:j])]
        bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)])
        coded = bodies.dictionary_encode()
        kind = coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((self.s, doc, self.ids[doc], kind))
        first = order[np.unique(kind[order], return_index=True)[1]]  # by kind
        by_key = np.argsort(key[first], kind="stable")
        self.first = first[by_key]
        number = np.empty(len(first), np.int64)
        number[by_key] = np.arange(len(first))
        self.kind = number[kind]
        self.first_key, self.first_doc = key[self.first], doc[self.first]
        self.texts = coded.dictionary.take(pa.array(by_key))
        self.piece_runs = runs_of(part_of(self.first_key, self.bits, self.parts))

    def ask_pieces(self):
        pieces, windows = {p: (i, j) for p, i, j in self.piece_runs}, {p: (i, j) for p, i, j in self.window_runs}
        for p in sorted(pieces.keys() | windows.keys()):
            i, j = pieces.get(p, (0, 0))
            d, x, more = self.first_doc[i:j], self.windows, {}
            raw, at = flat_bytes(self.texts.slice(i, j - i)) if j > i else (np.empty(0, np.uint8), np.zeros(1, np.int64))
            if p in windows:
                k = slice(*windows[p])
                more = {"h1": gaps(x["h1"][k]), "h2": x["h2"][k], "id1": self.ids[x["doc"][k]], "row1": x["doc"][k], "begin1": x["at"][k] - self.start[x["doc"][k]]}
            yield p, pack(h=gaps(self.first_key[i:j]), size=np.diff(at), raw=raw, id=self.ids[d], row=d, begin=self.s[self.first[i:j]] - self.start[d], **more)

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes go."""
        state, lost = np.zeros(len(self.first), np.int64), {}
        for p, i, j in self.piece_runs:
            x = unpack(answers[p])
            state[i:j] = x["state"]
            part = np.nonzero(x["state"] == 2)[0] + i
            for k, flags in zip(part.tolist(), np.split(x["flags"], np.cumsum(self.w[self.first[part]])[:-1]) if len(part) else (), strict=True):
                lost[k] = np.nonzero(flags)[0]
        is_first = np.zeros(len(self.s), bool)
        is_first[self.first] = True
        change = np.zeros(len(self.raw) + 1, np.int64)
        every = ~is_first | (state[self.kind] == 1)
        np.add.at(change, self.s[every], 1)
        np.add.at(change, self.s[every] + self.w[every] + self.length - 1, -1)
        for k, off in lost.items():
            s = self.s[self.first[k]] + off
            np.add.at(change, s, 1)
            np.add.at(change, s + self.length, -1)
        later = np.zeros(len(self.windows["at"]), bool)
        for p, i, j in self.window_runs:
            later[i:j] = unpack(answers[p])["later"]
        for s in (self.again, self.windows["at"][later]):
            np.add.at(change, s, 1)
            np.add.at(change, s + self.length, -1)
        return np.cumsum(change)[:-1] > 0


def flat_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


HEAD = "block long, part int, body binary"


def anchor_asker(length: int, bits: int, parts: int, hot: int):
    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                asked = list(Block(block, body, length, bits, parts, hot).ask_anchors())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(asked), pa.int64()), pa.array([p for p, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], names=["block", "part", "body"])

    return ask


def anchor_counter(hot: int):
    """Answers: 0 for anchors of one run of windows, 1 for those of several, 2 for those of too many for one shard."""

    def count(t: pa.Table) -> pa.Table:
        got = [unpack(b) for b in t.column("body").to_pylist()]
        keys = [np.cumsum(x["h"].astype(np.uint64), dtype=np.uint64) for x in got]
        u, inv = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate([x["n"] for x in got]), minlength=len(u))
        often = (n > 1).astype(np.uint8) + (n > hot)
        out = [pack(often=often[i]) for i in np.split(inv, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})

    return trim(count)


def restored(t: pa.Table, length: int, bits: int, parts: int, hot: int) -> tuple[Block, dict[int, bytes], dict[int, bytes]]:
    level, part, bodies = t.column("level").to_pylist(), t.column("part").to_pylist(), t.column("body").to_pylist()
    by: dict[int, dict[int, bytes]] = {0: {}, 1: {}, 2: {}}
    for k, p, body in zip(level, part, bodies, strict=True):
        by[k][p] = body
    return Block(t.column("block")[0].as_py(), by[0][0], length, bits, parts, hot), by[1], by[2]


def piece_asker(length: int, bits: int, parts: int, hot: int):
    def ask(t: pa.Table) -> pa.Table:
        b, told, _ = restored(t, length, bits, parts, hot)
        b.pieces(told)
        asked = list(b.ask_pieces())
        return pa.table({"block": pa.array([b.block] * len(asked), pa.int64()), "part": pa.array([p for p, _ in asked], pa.int32()), "body": pa.array([x for _, x in asked], pa.binary())})

    return trim(ask)


def later_windows(got: list[dict], blocks_: list[int]) -> list[np.ndarray]:
    """For each block's hot windows, which of them occur earlier in another block."""
    some = [x for x in got if "h1" in x]
    none = np.empty(0, np.uint64)
    h1 = np.concatenate([*[np.cumsum(x["h1"].astype(np.uint64), dtype=np.uint64) for x in some], none])
    h2, id_, row, begin = (np.concatenate([*[x[k].astype(kind) for x in some], none.astype(kind)]) for k, kind in (("h2", np.uint64), ("id1", np.int64), ("row1", np.int64), ("begin1", np.int64)))
    block = np.concatenate([*[np.full(len(x["h1"]), b, np.int64) for x, b in zip(got, blocks_, strict=True) if "h1" in x], none.astype(np.int64)])
    order = np.lexsort((begin, row, block, id_, h2, h1))
    later = np.zeros(len(h1), bool)
    later[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    return np.split(later, np.cumsum([len(x["h1"]) if "h1" in x else 0 for x in got])[:-1])


def sorter(length: int):
    """One shard: which pieces are not the first of their text, and which windows of the others occur earlier."""

    def sort(t: pa.Table) -> pa.Table:
        blocks_ = t.column("block").to_pylist()
        got = [unpack(b) for b in t.column("body").to_pylist()]
        cat = lambda k: np.concatenate([x[k].astype(np.int64) for x in got])
        key = np.concatenate([np.cumsum(x["h"].astype(np.uint64), dtype=np.uint64) for x in got])
        size, ids, rows, begin = cat("size"), cat("id"), cat("row"), cat("begin")
        block = np.repeat(np.array(blocks_, np.int64), [len(x["size"]) for x in got])
        at = np.concatenate([[0], np.cumsum(size)])
        bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate([x["raw"] for x in got]))])
        coded = bodies.dictionary_encode()
        kind = coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((begin, rows, block, ids, kind))
        first = order[np.unique(kind[order], return_index=True)[1]]
        state = np.ones(len(size), np.uint8)
        state[first] = 0
        k = np.argsort(key[first], kind="stable")
        first = first[k]
        _, inv, n = np.unique(key[first], return_inverse=True, return_counts=True)
        several = first[n[inv] > 1]
        flags: dict[int, np.ndarray] = {}
        if len(several):
            doc = np.stack([ids[several], block[several], rows[several]])
            rank = np.unique(doc, axis=1, return_inverse=True)[1].ravel()
            # Suffix arrays of bounded size: equal windows have one key, so that runs of keys are sorted apart.
            fresh = np.nonzero(np.concatenate([[True], key[several][1:] != key[several][:-1]]))[0]
            filled = np.cumsum(size[several])[fresh] // BATCH
            cuts = fresh[np.concatenate([[True], filled[1:] != filled[:-1]])]
            for lo, hi in zip(cuts, np.append(cuts[1:], len(several)), strict=True):
                some = several[lo:hi]
                texts = coded.dictionary.take(pa.array(kind[some])).to_pylist()
                for i, f in zip(some.tolist(), repeated_windows(texts, rank[lo:hi], begin[some], length), strict=True):
                    if f.all():
                        state[i] = 1
                    elif f.any():
                        state[i] = 2
                        flags[i] = f
        out, lo = [], 0
        for x, later in zip(got, later_windows(got, blocks_), strict=True):
            hi = lo + len(x["size"])
            mine = [flags[i] for i in range(lo, hi) if state[i] == 2]
            out.append(pack(state=state[lo:hi], flags=np.concatenate([*mine, np.zeros(0, bool)]).astype(np.uint8), later=later))
            lo = hi
        return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})

    return trim(sort)


def remover(length: int, bits: int, parts: int, hot: int, texts: bool):
    """Per document: sizes, removed bytes and runs, digest; or with texts, the other columns and the text that is left."""

    def remove(t: pa.Table) -> pa.Table:
        b, told, answers = restored(t, length, bits, parts, hot)
        b.pieces(told)
        gone = b.removed(answers)
        ends = np.concatenate([[0], np.cumsum(gone)])
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[b.start[b.size > 0]] = gone[b.start[b.size > 0]]
        runs = np.concatenate([[0], np.cumsum(begins)])
        stop = b.start + b.size
        lost, spans = ends[stop] - ends[b.start], runs[stop] - runs[b.start]
        whole = b.raw.tobytes()
        kept = [whole[s:e] if not n else b.raw[s:e][~gone[s:e]].tobytes() for s, e, n in zip(b.start.tolist(), stop.tolist(), lost.tolist(), strict=True)]
        if texts:
            rest = pa.ipc.open_stream(t.column("rest").drop_null()[0].as_py()).read_all()
            out = rest.append_column("text", pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
            return out.append_column("removed", pa.array(lost, pa.int64()))
        ids = pa.array(np.where(b.null, 0, b.ids), mask=b.null)
        return pa.table({"doc_id": ids, "n_bytes": b.size, "n_removed": lost, "n_spans": spans, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})

    return trim(remove)


def process(docs: DataFrame, length: int, texts: bool, doc_id: str, text: str, hot: int) -> DataFrame:
    """The rows of spans; or with texts (rest, text, removed), rest a struct of the document's other columns."""
    rest = F.struct(*([named(c) for c in docs.columns if texts and c != text] or [F.lit(0).alias("none")]))
    source = docs.select(named(text).alias("text"), named(doc_id).cast("long").alias("id"), rest.alias("rest"))
    table = stash(source.mapInArrow(collect, "block long, bytes long, body binary, rest binary"))
    parts = count_parts(table, "bytes")
    bits = min(62, 33 + parts.bit_length())
    asked = table.select("block", "body").mapInArrow(anchor_asker(length, bits, parts, hot), HEAD)
    told = stash(asked.groupBy("part").applyInArrow(anchor_counter(hot), HEAD))
    bodies = table.select("block", F.lit(0).alias("level"), F.lit(0).alias("part"), "body", F.col("rest") if texts else F.lit(None).cast("binary").alias("rest"))
    level = lambda df, k: df.select("block", F.lit(k).alias("level"), "part", "body", F.lit(None).cast("binary").alias("rest"))
    pieces = bodies.drop("rest").unionByName(level(told, 1).drop("rest")).groupBy("block").applyInArrow(piece_asker(length, bits, parts, hot), HEAD)
    judged = stash(pieces.groupBy("part").applyInArrow(sorter(length), HEAD))
    rows = bodies.unionByName(level(told, 1)).unionByName(level(judged, 2))
    if not texts:
        return rows.groupBy("block").applyInArrow(remover(length, bits, parts, hot, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    schema = T.StructType([T.StructField("rest", source.schema["rest"].dataType), T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())])
    return rows.groupBy("block").applyInArrow(remover(length, bits, parts, hot, True), schema)


def spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return process(docs, length, False, doc_id, text, hot)


def strip(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The documents with what is left of their texts (halves of cut characters go too); those that lost all go.

    A null text comes back empty."""
    out = process(docs, length, True, doc_id, text, hot).where((F.col("removed") == 0) | (F.col("text") != ""))
    return out.select(*[(F.col("text") if c == text else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))


QUERIES = {"op7_suffix_array": op7_suffix_array}
ORACLES: dict[str, str] = {}
