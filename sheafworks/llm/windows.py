"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles, hashed. Blocks first ask, packed, which shingles occur in two texts
anywhere. A passage that matches another one shares NUM / DEN of its shingles with it: only stretches in which runs of
`least` shingles and more reach that share of such shingles are looked at (covered), which loses no match.

In these stretches, under each of K hash functions every passage of at least `least` shingles has one least element, and
all passages with the same one form a compact window (L, c, R): passages that begin in L..c and end in c..R. The windows
are the nodes of the Cartesian tree over the hashes whose range is long enough; their centres are exactly the minima of
the sliding windows of that length, and bounds are the next smaller centres. Functions are taken in pairs (BANDS). Within
a text the windows of a pair are joined as intervals: each two centres that are the minima of one passage give the
rectangle of all passages of which they are, and the two shingles are its signature.

1. Blocks ask, packed, who else has a signature: the answer is the representative's rectangle, that of the first row of
   the most frequent passage around the centres. A block then has all that its texts share with representatives.
2. For each two texts the rectangles are joined as intervals, and each maximal stretch is verified: all passages of
   `least` shingles or more with the wanted Jaccard similarity are taken from it.
3. Overlapping matches of a text are one passage; passages that are matched, directly or by way of others, are a class.
4. Blocks ask which signatures have rectangles of more than one class (or of none) that may match. Their rectangles meet
   all of the signature that are not of their own class, and are verified likewise. So a pair that differs from its
   representative still meets; within a class, copies are not expanded into all pairs.

Two passages of similarity s share a pair's signature with a chance of s * s for each of the BANDS (0.98 for one of them
at 0.8, more where they are longer than `least`); repeats that are equal share all. Verification is exact, on 32-bit
hashes of the shingles: it tries all bounds that can be best.

Defined cases: null texts and texts shorter than a passage match nothing; texts equal in all shingles are compared once
and the others reported as copies of the first; equal rows are such copies; null ids are reported as null;
repeats within one text are not reported; other columns play no part; empty in, empty out; a text larger than a block
is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafworks.llm.common import BLOCK_ROWS, ROW_BITS, components, count_parts, documents, drop, gaps, give_back, named, pack, part_of, row_ids, runs_of, stash, trim, unpack
from sheafworks.llm.jaccard import MULT, mix, tokenise, total

#: Words of a shingle, hash functions, shingles of the shortest passage (50 words), similarity.
WIDTH, K, LEAST, NUM, DEN = 5, 8, 46, 80, 100
#: Pairs of functions whose minima are a signature: of any five functions that agree two are a pair.
BANDS = [(k, k + 1) for k in range(0, K, 2)]


def sequence(b: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, end to end, and how many each has."""
    n = b["n"].astype(np.int64)
    h = b["words"].astype(np.uint64)[b["tokens"].astype(np.int64)] if len(b["tokens"]) else np.empty(0, np.uint64)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        full += h[j : j + len(full)] * MULT[j]
    m = np.maximum(0, n - width + 1)
    start, ends = np.cumsum(n) - n, np.cumsum(m)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - m), m)
    return mix(full, 5)[at], m


def least_of_runs(h: np.ndarray, m: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `least` elements within a text: where it begins, and where its least element is."""
    none = np.empty(0, np.int64)
    if len(h) < least:
        return none, none
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= least:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < least:
        low = np.minimum(low[: len(low) - (least - span)], low[least - span :])
    start = np.cumsum(m) - m
    ok = np.zeros(len(h) + 1, np.int64)
    long = m >= least
    ok[start[long]] += 1
    np.add.at(ok, (start + m - least + 1)[long], -1)
    inside = np.nonzero(np.cumsum(ok)[: len(low)] > 0)[0]
    return inside, (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def compact_windows(h: np.ndarray, m: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(L, c, R) over the texts end to end: each c that is least in some run of `least`, and how far it stays so."""
    c = np.unique(least_of_runs(h, m, least)[1])
    if not len(c):
        return c, c, c
    start = np.cumsum(m) - m
    value = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    doc = np.searchsorted(start, c, side="right") - 1
    # a text's ends are smaller than all its elements
    first, last = start[doc], start[doc] + m[doc] - 1
    left, right = first.copy(), last.copy()
    stack: list[int] = []
    values, docs = value[c].tolist(), doc.tolist()
    cs, lo, hi = c.tolist(), left.tolist(), right.tolist()
    for k in range(len(cs)):
        while stack and (docs[stack[-1]] != docs[k] or values[stack[-1]] > values[k]):
            top = stack.pop()
            if docs[top] == docs[k]:
                hi[top] = cs[k] - 1
        if stack:
            lo[k] = cs[stack[-1]] + 1
        stack.append(k)
    return np.array(lo, np.int64), c, np.array(hi, np.int64)


def covered(hit: np.ndarray, again: np.ndarray, m: np.ndarray, least: int, worth: int, cost: int, sum_: int) -> np.ndarray:
    """Which elements of texts end to end are in some run of `least` or more whose hits and misses add up to that sum at least.

    A miss that occurs earlier in the text costs nothing, so that no run is lost whose distinct elements have that sum.
    """
    n, start = len(hit), np.cumsum(m) - m
    if not n:
        return np.zeros(0, bool)
    # places are between elements; every text has one more, and lies below all earlier ones
    at = np.arange(n) + np.repeat(np.arange(len(m)), m)
    weight = np.zeros(n + len(m), np.int64)
    weight[at + 1] = np.where(hit, worth, np.where(again, 0, -cost))
    weight[start + np.arange(len(m))] = -(worth + cost) * (np.append(0, m[:-1]) + m + 1) - sum_
    sums = np.cumsum(weight)
    # the first place of each run that ends here and has that sum
    begin = np.searchsorted(-np.minimum.accumulate(sums), sum_ - sums, side="left")
    ends = np.nonzero(np.arange(len(sums)) - begin >= least)[0]
    inside = np.zeros(len(sums) + 1, np.int64)
    np.add.at(inside, begin[ends] + 1, 1)
    np.add.at(inside, ends + 1, -1)
    return np.cumsum(inside)[at + 1] > 0


class Passages:
    """A block's shingles, those that other texts share, and the signatures of what they cover in the first text of each kind."""

    def __init__(self, block: int, body: bytes, bits: int, parts: int, least: int):
        b = unpack(body)
        self.ids, self.null = b["ids"].astype(np.int64), b["null"].astype(bool)
        self.h, self.m = sequence(b, WIDTH)
        self.start = np.cumsum(self.m) - self.m
        place = np.arange(len(self.h), dtype=np.uint64) - np.repeat(self.start, self.m).astype(np.uint64)
        self.sig = [total(mix(self.h + place * MULT[k], k), self.m) for k in (1, 2)]
        order = np.lexsort((np.arange(len(self.m)), self.m, self.sig[1], self.sig[0]))
        new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (*self.sig, self.m)], axis=0)]) if len(order) else np.zeros(0, bool)
        self.same = np.empty(len(self.m), np.int64)
        self.same[order] = order[new][np.cumsum(new) - 1]
        self.rows = row_ids(block, len(self.m))
        kept = order[new]  # by signature
        self.asked = kept[self.m[kept] >= least]
        only = np.zeros(len(self.m), np.int64)
        only[self.asked] = self.m[self.asked]
        self.h1, self.m1 = self.h[np.repeat(only > 0, self.m)], only
        self.least, self.bits = least, bits
        # distinct shingles, and in how many texts they are
        v = self.h1 >> np.uint64(64 - bits)
        self.order = np.argsort(v, kind="stable")
        v, doc = v[self.order], np.repeat(np.arange(len(only)), only)[self.order]
        self.new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
        self.again = np.concatenate([[False], ~self.new[1:] & (doc[1:] == doc[:-1])]) if len(v) else np.zeros(0, bool)
        self.keys = v[self.new]
        self.count = np.add.reduceat((~self.again).astype(np.int64), np.nonzero(self.new)[0]) if len(v) else np.zeros(0, np.int64)
        self.runs = runs_of(part_of(self.keys, bits, parts))
        self.text_runs = runs_of(part_of(self.sig[0][self.asked], 64, parts))

    def ask(self):
        """Questions by partition: shingles with how often they occur here, and whole texts."""
        keys, texts = {p: (i, j) for p, i, j in self.runs}, {p: (i, j) for p, i, j in self.text_runs}
        for p in sorted(keys.keys() | texts.keys()):
            i, j = keys.get(p, (0, 0))
            t = self.asked[slice(*texts.get(p, (0, 0)))]
            yield p, pack(h=gaps(self.keys[i:j]), n=np.minimum(self.count[i:j], 2).astype(np.uint8), s1=self.sig[0][t], s2=self.sig[1][t], m=self.m[t], row=self.rows[t])

    def learn(self, answers: dict[int, bytes], num: int, den: int) -> None:
        """Which shingles occur in two texts, the first row anywhere of each text, and what passages can cover."""
        twice, low = np.zeros(len(self.keys), bool), self.rows.copy()
        got = {p: unpack(body) for p, body in answers.items()}
        for p, i, j in self.runs:
            twice[i:j] = got[p]["twice"]
        for p, i, j in self.text_runs:
            low[self.asked[i:j]] = got[p]["first"]
        own = low == self.rows
        self.same = low[self.same]
        hit, again = np.zeros(len(self.h1), bool), np.zeros(len(self.h1), bool)
        hit[self.order], again[self.order] = twice[np.cumsum(self.new) - 1], self.again
        # runs of what is covered, within a text, as texts of their own
        doc = np.repeat(np.arange(len(self.m1)), self.m1)
        at = np.nonzero(covered(hit, again, self.m1, self.least, den - num, num, 0) & own[doc])[0]
        first = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]))[0] if len(at) else np.zeros(0, np.int64)
        self.h2, self.m2 = self.h1[at], np.diff(first, append=len(at))
        self.start2, self.doc2 = first, doc[at[first]]
        self.place2 = at[first] - (np.cumsum(self.m1) - self.m1)[self.doc2]
        # (den + num) * common >= num * (S + T), T being `least` or more where nothing recurs
        self.strong = covered(hit[at], again[at], self.m2, self.least, den, num, num * self.least)
        self.loops = total(again[at].astype(np.int64), self.m2) > 0

    def rectangles(self) -> dict[str, np.ndarray]:
        """v, content, text, kind, L, centres, R of what is covered, by signature and text.

        Content is that of the passage of `least` shingles around the centres. Kind is 1 where shingles recur, else 2
        where a passage around the centres has hits enough for one without such shingles to match, else 0.
        """
        least, bounds, low, found = self.least, [], [], []
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h2, 6), dtype=np.uint64)])
        for k in range(K):
            h = mix(self.h2, k)
            at, lowest = least_of_runs(h, self.m2, least)
            low.append(lowest)
            lo, c, hi = compact_windows(h, self.m2, least)
            bounds.append((c, lo, hi))
        strong = np.concatenate([[0], np.cumsum(self.strong)])
        for n, (x, y) in enumerate(BANDS):
            # where runs of passages with the same two minima begin
            p, q = low[x], low[y]
            first = np.nonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)]))[0] if len(at) else np.zeros(0, np.int64)
            p, q = p[first], q[first]
            v = mix(mix(self.h2[p], x) + mix(self.h2[q] * MULT[n % 8], y) + np.uint64(n), n)
            at_x, at_y = np.searchsorted(bounds[x][0], p), np.searchsorted(bounds[y][0], q)
            lo, hi = np.maximum(bounds[x][1][at_x], bounds[y][1][at_y]), np.minimum(bounds[x][2][at_x], bounds[y][2][at_y])
            p, q = np.minimum(p, q), np.maximum(p, q)
            run = np.searchsorted(self.start2, p, side="right") - 1
            around = np.clip(p - (least - (q - p + 1)) // 2, self.start2[run], self.start2[run] + self.m2[run] - least)
            shift = self.place2[run] - self.start2[run]
            found.append((v >> np.uint64(64 - self.bits), (sums[around + least] - sums[around]) >> np.uint64(32), self.doc2[run], np.where(self.loops[run], 1, 2 * (strong[q + 1] - strong[p] == q + 1 - p)), lo + shift, p + shift, q + shift, hi + shift))
        v, content, doc, kind, *places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((places[1], doc, v))
        return dict(zip(("v", "s", "doc", "kind", *PLACES), (x[order] for x in (v, content, doc, kind, *places)), strict=True))


HEAD = "block long, part int, body binary"
PLACES = ("lo", "p", "q", "hi")


def asker(bits: int, parts: int, least: int):
    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                asked = list(Passages(block, body, bits, parts, least).ask())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(asked), pa.int64()), pa.array([p for p, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], names=["block", "part", "body"])
                give_back()

    return ask


def add_up(t: pa.Table) -> pa.Table:
    got = [unpack(b) for b in t.column("body").to_pylist()]
    keys = [np.cumsum(x["h"].astype(np.uint64), dtype=np.uint64) for x in got]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    twice = (np.bincount(inv, weights=np.concatenate([x["n"] for x in got]), minlength=len(u)) > 1).astype(np.uint8)
    s1, s2, m, row = (np.concatenate([x[n].astype(np.uint64) for x in got]) for n in ("s1", "s2", "m", "row"))
    order = np.lexsort((row, m, s2, s1))
    new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (s1, s2, m)], axis=0)]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(row), np.uint64)
    first[order] = row[order][new][np.cumsum(new) - 1] if len(order) else row
    parts = [np.split(x, np.cumsum([len(v) for v in sizes])[:-1]) for x, sizes in ((inv, keys), (first, [x["row"] for x in got]))]
    out = [pack(twice=twice[i], first=f) for i, f in zip(*parts, strict=True)]
    return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})


def messages(block: int, messages: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(messages), pa.int64()), "part": pa.array([p for p, _ in messages], pa.int32()), "body": pa.array([x for _, x in messages], pa.binary())})


def emitter(bits: int, parts: int, least: int, num: int, den: int):
    """A block's rows (part -2), its rectangles (-1), and what it asks of each partition of signatures."""

    def emit(t: pa.Table) -> pa.Table:
        part, bodies = t.column("part").to_pylist(), t.column("body").to_pylist()
        block = t.column("block")[0].as_py()
        s = Passages(block, bodies[part.index(-1)], bits, parts, least)
        s.learn({p: body for p, body in zip(part, bodies, strict=True) if p >= 0}, num, den)
        r = s.rectangles()
        out = [(-2, pack(ids=s.ids, null=s.null.astype(np.uint8), same=s.same, m=s.m)), (-1, pack(**{n: gaps(x) if n == "v" else x for n, x in r.items()}))]
        # each content once, by signature
        order = np.lexsort((r["doc"], r["s"], r["v"]))
        order = order[firsts(*(r[k][order] for k in ("v", "s", "doc")))[0]]
        first, n = firsts(r["v"][order], r["s"][order])
        r = {k: x[order[first]] for k, x in r.items()}
        for p, i, j in runs_of(part_of(r["v"], bits, parts)):
            out.append((p, pack(v=gaps(r["v"][i:j]), s=r["s"][i:j], n=n[i:j], row=s.rows[r["doc"][i:j]], **{k: r[k][i:j] for k in PLACES})))
        return messages(block, out)

    return trim(emit)


def rows_of(t: pa.Table) -> pa.Table:
    got = unpack(t.column("body")[0].as_py())
    rows = (np.int64(t.column("block")[0].as_py()) << ROW_BITS) + np.arange(len(got["ids"]), dtype=np.int64)
    return pa.table({"row": pa.array(rows), "doc_id": pa.array(got["ids"].astype(np.int64), mask=got["null"].astype(bool)), "same": pa.array(got["same"].astype(np.int64)), "m": pa.array(got["m"].astype(np.int64))})


def firsts(*sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of sorted arrays begin, and how long they are."""
    n = len(sorted_by[0])
    first = np.nonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)]))[0] if n else np.zeros(0, np.int64)
    return first, np.diff(first, append=n)


def elect(t: pa.Table) -> pa.Table:
    """For each block the representative of each of its signatures that several texts have.

    It is the first row of the most frequent content, with its rectangle; blocks have added up their own rows before.
    """
    got = [unpack(b) for b in t.column("body").to_pylist()]
    keys = [np.cumsum(x["v"].astype(np.uint64), dtype=np.uint64) for x in got]
    v, content, row, n = np.concatenate(keys), *(np.concatenate([x[k].astype(np.int64) for x in got]) for k in ("s", "row", "n"))
    order = np.lexsort((row, content, v))
    first, _ = firsts(v[order], content[order])
    total_n = np.add.reduceat(n[order], first) if len(first) else first
    best = order[first]
    order = np.lexsort((row[best], -total_n, v[best]))
    best, total_n = best[order], total_n[order]
    first, _ = firsts(v[best])
    many = (np.maximum.reduceat(total_n, first) > 1) | (np.minimum.reduceat(row[best], first) < np.maximum.reduceat(row[best], first)) if len(first) else first > 0
    hub, signature = best[first], v[best[first]]
    cols = {k: np.concatenate([x[k].astype(np.int64) for x in got])[hub] for k in PLACES} | {"row": row[hub]}
    out = []
    for key in keys:
        at = np.searchsorted(signature, key[firsts(key)[0]])
        some = many[at]
        out.append(pack(some=some.astype(np.uint8), **{k: c[at[some]] for k, c in cols.items()}))
    return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})


def meeter(bits: int, parts: int, least: int):
    """The stretches that a block's texts share with the representatives of their signatures."""

    def meet(t: pa.Table) -> pa.Table:
        part, bodies = t.column("part").to_pylist(), t.column("body").to_pylist()
        got = {p: unpack(b) for p, b in zip(part, bodies, strict=True)}
        r = got[-1]
        v = np.cumsum(r["v"].astype(np.uint64), dtype=np.uint64)
        rows = (np.int64(t.column("block")[0].as_py()) << ROW_BITS) + r["doc"].astype(np.int64)
        first, n = firsts(v)
        hub, places = np.full(len(first), -1), np.zeros((len(first), 3), np.int64)
        for p, i, j in runs_of(part_of(v[first], bits, parts)):
            some = i + np.nonzero(got[p]["some"])[0]
            hub[some] = got[p]["row"].astype(np.int64)
            places[some] = np.stack([got[p][k].astype(np.int64) for k in ("lo", "p", "hi")], axis=1)
        hub, places = np.repeat(hub, n), np.repeat(places, n, axis=0)
        ok = np.nonzero((hub >= 0) & (hub != rows))[0]
        x = np.concatenate([np.stack([r[k].astype(np.int64) for k in ("lo", "p", "hi")], axis=1), places], axis=1)
        ok = ok[np.lexsort((hub[ok], rows[ok]))]
        return stretches(rows[ok], hub[ok], x[ok], least)

    return trim(meet)


def placed(bits: int, parts: int, least: int):
    """A block's rectangles that others share, with their labels (part -1), and which labels each signature has here.

    All passages of `least` that have a rectangle's minima hold its core. Where the core overlaps matched passages of one
    class only, whatever else matches there is of that class, which is the label; elsewhere it is the row's own.
    """

    def place(t: pa.Table) -> pa.Table:
        block, told = t.column("block")[0].as_py(), t.filter(pa.compute.is_valid(t.column("body")))
        got = {p: unpack(b) for p, b in zip(told.column("part").to_pylist(), told.column("body").to_pylist(), strict=True)}
        r = {k: x.astype(np.int64) for k, x in got[-1].items() if k != "v"} | {"v": np.cumsum(got[-1]["v"].astype(np.uint64), dtype=np.uint64)}
        first, n = firsts(r["v"])
        some = np.zeros(len(first), bool)
        for p, i, j in runs_of(part_of(r["v"][first], bits, parts)):
            some[i:j] = got[p]["some"]
        r = {k: x[np.repeat(some, n)] for k, x in r.items()}
        matched = t.filter(pa.compute.is_valid(t.column("row")))
        row, begin, end, name = (matched.column(k).to_numpy() for k in ("row", "first", "last", "label"))
        doc = row & (BLOCK_ROWS - 1)
        order = np.lexsort((begin, doc))
        begin, end, name = ((doc << 40) + begin)[order], ((doc << 40) + end)[order], name[order]
        label = -1 - r["doc"] - (np.int64(block) << ROW_BITS)
        low, high = np.minimum(r["p"], r["hi"] - least + 1), np.maximum(r["q"], r["lo"] + least - 1) + WIDTH - 1
        i, j = np.searchsorted(end, (r["doc"] << 40) + low, side="left"), np.searchsorted(begin, (r["doc"] << 40) + high, side="right") - 1
        at = np.nonzero(i <= j)[0]
        other = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]])) if len(name) else name
        at = at[other[i[at]] == other[j[at]]]
        label[at] = name[i[at]]
        out = [(-1, pack(**{k: gaps(x) if k == "v" else x for k, x in r.items()}, label=label))]
        first, n = firsts(r["v"])
        if len(first):
            top, loops = np.iinfo(np.int64).max, np.maximum.reduceat((r["kind"] == 1).astype(np.uint8), first)
            low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            strong = r["kind"] > 0
            low2, high2 = np.minimum.reduceat(np.where(strong, label, top), first), np.maximum.reduceat(np.where(strong, label, -top), first)
            for p, i, j in runs_of(part_of(r["v"][first], bits, parts)):
                out.append((p, pack(v=gaps(r["v"][first[i:j]]), loops=loops[i:j], low=low[i:j], high=high[i:j], low2=low2[i:j], high2=high2[i:j])))
        return messages(block, out)

    return trim(place)


def unsettled(t: pa.Table) -> pa.Table:
    """Which signatures have rectangles of several classes that may match: 1, or 2 where a text with recurring shingles is among them."""
    got = [unpack(b) for b in t.column("body").to_pylist()]
    keys = [np.cumsum(x["v"].astype(np.uint64), dtype=np.uint64) for x in got]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(inv, kind="stable")
    first, _ = firsts(inv[order])
    of = lambda k, f: f.reduceat(np.concatenate([x[k].astype(np.int64) for x in got])[order], first)
    loops = of("loops", np.maximum) > 0
    open_ = np.where(loops, 2 * (of("low", np.minimum) < of("high", np.maximum)), of("low2", np.minimum) < of("high2", np.maximum)).astype(np.uint8)
    out = [pack(open=open_[i]) for i in np.split(inv, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"block": t.column("block"), "part": t.column("part"), "body": pa.array(out, pa.binary())})


STRETCHES = "a long, b long, la long, ra long, lb long, rb long"
OPEN = "v long, row long, label long, kind int, lo int, p int, hi int, body binary"
MET = "a long, b long, la long, ca long, ra long, lb long, cb long, rb long"
#: Rectangles of a signature that one tile holds; rectangles of a task, and pairs of them.
TILE, MEETING, MEANT = 256, 4_000, 40_000


def opener(bits: int, parts: int):
    """The rectangles of signatures that are not settled, and 16 bits of each shingle in them.

    Those of a text, signature and label that overlap are one: what passages of them match lies in it.
    """

    def open_(t: pa.Table) -> pa.Table:
        got = dict(zip(t.column("part").to_pylist(), t.column("body").to_pylist(), strict=True))
        h, m = sequence(unpack(got.pop(-3)), WIDTH)
        small, start = (h >> np.uint64(48)).astype(np.uint16), np.cumsum(m) - m
        got = {p: unpack(body) for p, body in got.items()}
        r = got[-1]
        v = np.cumsum(r["v"].astype(np.uint64), dtype=np.uint64)
        first, n = firsts(v)
        state = np.zeros(len(first), np.uint8)
        for p, i, j in runs_of(part_of(v[first], bits, parts)):
            state[i:j] = got[p]["open"]
        state = np.repeat(state, n)
        ok = np.nonzero((state == 2) | (state == 1) & (r["kind"] > 0))[0]
        v, doc, label, kind, lo, at, hi = v[ok].astype(np.int64), *(r[k][ok].astype(np.int64) for k in ("doc", "label", "kind", "lo", "p", "hi"))
        order = np.lexsort((lo, label, doc, v))
        v, doc, label, kind, lo, at, hi = (x[order] for x in (v, doc, label, kind, lo, at, hi))
        n = firsts(v, doc, label)[1]
        of = np.repeat(np.arange(len(n)), n)
        reach = np.maximum.accumulate(hi + (of << 40)) - (of << 40)
        first = np.nonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] > reach[:-1])]))[0] if len(ok) else of
        if len(first):
            loops, strong = np.maximum.reduceat(kind == 1, first), np.maximum.reduceat(kind, first)
            v, doc, label, kind, lo, at, hi = v[first], doc[first], label[first], np.where(loops, 1, strong), lo[first], np.minimum.reduceat(at, first), np.maximum.reduceat(hi, first)
        rows = (np.int64(t.column("block")[0].as_py()) << ROW_BITS) + doc
        bodies = [small[i : j + 1].tobytes() for i, j in zip((start[doc] + lo).tolist(), (start[doc] + hi).tolist(), strict=True)]
        return pa.table({"v": v, "row": rows, "label": label, **{k: x.astype(np.int32) for k, x in (("kind", kind), ("lo", lo), ("p", at), ("hi", hi))}, "body": pa.array(bodies, pa.binary())})

    return trim(open_)


def may_match(hit: np.ndarray, again: np.ndarray, start: np.ndarray, least: int, num: int, den: int) -> np.ndarray:
    """2 for each text end to end with a run of `least` or more that holds the mean share of hits, 1 for num / den of them, else 0.

    A miss that occurs earlier costs nothing, so that no run is lost whose distinct elements have that share.
    """
    n, found = np.diff(start, append=len(hit)), np.zeros(len(start), np.int64)
    at = np.arange(len(hit)) + np.repeat(np.arange(len(start)), n)
    for cost in (num, 2 * num):
        weight = np.zeros(len(hit) + len(start), np.int64)
        weight[at + 1] = np.where(hit, den - num, np.where(again, 0, -cost))
        # places are between elements; every text has one more, and lies below all earlier ones
        begin = start + np.arange(len(start))
        weight[begin] = -(den + cost) * (np.append(0, n[:-1]) + n + 1)
        sums = np.cumsum(weight)
        gain = np.full(len(sums), -1)
        gain[least:] = sums[least:] - np.minimum.accumulate(sums)[: max(0, len(sums) - least)]
        found += np.maximum.reduceat(gain, begin) >= 0
    return found


def meeter_of_labels(least: int, num: int, den: int):
    """(a, b, la, ca, ra, lb, cb, rb) of the rectangles of a signature that are of two labels, of kinds that may match and hold passages that may.

    A passage that matches has num / den of its shingles in the other, and the smaller the mean share; both lie in the
    rectangles. With 16 bits of a shingle some hits are none, so that no pair is lost. Those of side 0 meet those of side 1
    of their tile, those of side -1 each other; all but the most frequent label are taken one by one.
    """

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("v", "ascending"), ("i", "ascending"), ("j", "ascending")])
        v, i, j, side, row, label, kind, lo, p, hi = (t.column(k).to_numpy().astype(np.int64) for k in ("v", "i", "j", "side", "row", "label", "kind", "lo", "p", "hi"))
        n = hi - lo + 1
        code = np.frombuffer(b"".join(t.column("body").to_pylist()), np.uint16)
        start = np.cumsum(n) - n
        key = (np.repeat(np.arange(len(n)), n) << 16) + code
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        del key, order
        mark, place, out = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.int64), [np.zeros((0, 2), np.int64)]
        first, _ = firsts(v, i, j)
        for tile in np.split(np.arange(len(v)), first[1:]):
            alone = len(tile) and side[tile[0]] < 0
            if alone:
                _, of, count = np.unique(label[tile], return_inverse=True, return_counts=True)
                often = of == np.argmax(count)
                ones, others = tile[~often], np.concatenate([tile[often], tile[~often]])
            else:
                ones, others = sorted((tile[side[tile] == k] for k in (0, 1)), key=len)
            if not len(ones):
                continue
            begin = np.cumsum(n[others]) - n[others]
            whole = np.repeat(start[others] - begin, n[others]) + np.arange(n[others].sum())
            codes, repeats = code[whole], again[whole]
            for k, x in enumerate(ones.tolist()):
                ok = (label[others] != label[x]) & (row[others] != row[x]) & ((kind[others] > 0) | (kind[x] == 1)) & ((kind[x] > 0) | (kind[others] == 1))
                if alone:  # each two once
                    ok[len(others) - len(ones) :][: k + 1] = False
                if not ok.any():
                    continue
                mine, free = code[start[x] : start[x] + n[x]], again[start[x] : start[x] + n[x]]
                mark[mine] = True
                hit = mark[codes]
                mark[mine] = False
                of_y = may_match(hit, repeats, begin, least, num, den)
                some = np.nonzero(ok & (of_y > 0))[0]
                if not len(some):
                    continue
                kinds, mine_at = np.unique(mine, return_inverse=True)
                place[kinds] = np.arange(len(kinds))
                has = np.zeros((len(some), len(kinds)), bool)
                taken = np.concatenate([np.arange(begin[y], begin[y] + n[others[y]]) for y in some.tolist()])
                whose = np.repeat(np.arange(len(some)), n[others[some]])
                whose, taken = whose[hit[taken]], taken[hit[taken]]
                has[whose, place[codes[taken]]] = True
                of_x = may_match(has[:, mine_at].reshape(-1), np.tile(free, len(some)), np.arange(len(some)) * n[x], least, num, den)
                some = others[some[(of_x > 0) & ((of_x > 1) | (of_y[some] > 1))]]
                out.append(np.stack([np.full(len(some), x), some], axis=1))
        a, b = np.concatenate(out).T
        a, b = np.where(row[a] > row[b], a, b), np.where(row[a] > row[b], b, a)
        return pa.table({"a": row[a], "b": row[b], "la": lo[a], "ca": p[a], "ra": hi[a], "lb": lo[b], "cb": p[b], "rb": hi[b]})

    return trim(meet)


def stretches_of(x: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Maximal stretches of two texts (la, ra, lb, rb) from the rectangles that they share: L, centre, R in each.

    A sweep by shift parts rectangles whose shifts are more than a passage apart; a sweep by place then joins the
    intervals that overlap, so that the work is that of two sorts.
    """
    shift = x[:, 1] - x[:, 4]
    order = np.argsort(shift, kind="stable")
    lane = np.empty(len(x), np.int64)
    lane[order] = np.cumsum(np.concatenate([[0], np.diff(shift[order]) > least]))
    x, lane = x[order := np.lexsort((x[:, 0], lane))], lane[order]
    reach = np.maximum.accumulate(x[:, 2] + lane * (1 << 40)) - lane * (1 << 40)
    new = np.nonzero(np.concatenate([[True], (lane[1:] != lane[:-1]) | (x[1:, 0] > reach[:-1])]))[0]
    low, high = np.minimum.reduceat(x, new), np.maximum.reduceat(x, new)
    return list(zip(low[:, 0].tolist(), high[:, 2].tolist(), low[:, 3].tolist(), high[:, 5].tolist(), strict=True))


def stretches(a: np.ndarray, b: np.ndarray, x: np.ndarray, least: int) -> pa.Table:
    """Those of all pairs of texts, the rectangles of a pair being neighbours."""
    edge = np.concatenate([[0], np.nonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))[0] + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    out = [(int(a[lo]), int(b[lo]), *s) for lo, hi in zip(edge[:-1], edge[1:], strict=True) for s in stretches_of(x[lo:hi], least)]
    return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("a", "b", "la", "ra", "lb", "rb"))})


def joiner(least: int):
    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        x = np.stack([t.column(n).to_numpy().astype(np.int64) for n in ("la", "ca", "ra", "lb", "cb", "rb")], axis=1)
        return stretches(t.column("a").to_numpy(), t.column("b").to_numpy(), x, least)

    return trim(join)


def slicer():
    """The shingles of the stretches that are asked for, as 32-bit hashes."""

    def cut(t: pa.Table) -> pa.Table:
        bodies = [x for x in t.column("body").to_pylist() if x is not None]
        h, m = sequence(unpack(bodies[0]), WIDTH)
        start = np.cumsum(m) - m
        small = (h >> np.uint64(32)).astype(np.uint32)
        asked = t.filter(pa.compute.is_valid(t.column("row")))
        row, lo, hi = (asked.column(n).to_pylist() for n in ("row", "lo", "hi"))
        got = [small[start[r & (BLOCK_ROWS - 1)] + i : start[r & (BLOCK_ROWS - 1)] + j + 1].tobytes() for r, i, j in zip(row, lo, hi, strict=True)]
        return pa.table({"row": asked.column("row"), "lo": asked.column("lo"), "hi": asked.column("hi"), "body": pa.array(got, pa.binary())})

    return trim(cut)


def best_stretch(hit: np.ndarray, worth: int, cost: int) -> tuple[int, int]:
    """First and last element of the run that gains most, a hit counting for and a miss against it."""
    sums = np.concatenate([[0], np.cumsum(np.where(hit, worth, -cost))])
    low = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - low))
    begin = int(np.argmin(sums[: end + 1]))
    return begin, end


def longest_stretch(hit: np.ndarray, worth: int, cost: int) -> tuple[int, int]:
    """First and last hit of the longest run that loses nothing, a hit counting for and a miss against it."""
    sums = np.concatenate([[0], np.cumsum(np.where(hit, worth, -cost))])
    high = np.maximum.accumulate(sums[::-1])[::-1]
    end = np.searchsorted(-high, -sums, side="right") - 1
    begin = int(np.argmax(end - np.arange(len(sums))))
    at = np.nonzero(hit[begin : end[begin]])[0]
    return (begin + int(at[0]), begin + int(at[-1])) if len(at) else (0, 0)


def equal_run(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, int, int, int] | None:
    """Bounds of the first equal run of at least `least` elements in both, or None."""
    if min(len(x), len(y)) < least:
        return None
    roll = lambda z: np.lib.stride_tricks.sliding_window_view(z.astype(np.uint64), least) @ weights
    weights = mix(np.arange(1, least + 1, dtype=np.uint64), 3)
    hx, hy = roll(x), roll(y)
    for i in np.nonzero(np.isin(hx, hy))[0]:
        for p in np.nonzero(hy == hx[i])[0]:
            if np.array_equal(x[i : i + least], y[p : p + least]):
                n = min(len(x) - i, len(y) - p)
                apart = np.nonzero(x[i : i + n] != y[p : p + n])[0]
                n = int(apart[0]) if len(apart) else n
                return int(i), int(i) + n - 1, int(p), int(p) + n - 1
    return None


def held(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """Which of x are in y; both hold numbers below kinds."""
    has = np.zeros(kinds, bool)
    has[y] = True
    return has[x]


def similarity_of(x: np.ndarray, y: np.ndarray, kinds: int, num: int, den: int) -> float:
    """Jaccard similarity of two runs, or 0 where it is too low."""
    s, t = np.zeros(kinds, bool), np.zeros(kinds, bool)
    s[x], t[y] = True, True
    common, union = np.count_nonzero(s & t), np.count_nonzero(s | t)
    return common / union if den * common >= num * union else 0.0


def has_run(hit: np.ndarray, least: int, share: float) -> bool:
    """Whether a run of `least` or more holds that share of hits."""
    if len(hit) < least:
        return False
    sums = np.concatenate([[0.0], np.cumsum(hit - share)])
    return bool((sums[least:] - np.minimum.accumulate(sums[: len(sums) - least])).max() >= -1e-9)


def possible(hx: np.ndarray, hy: np.ndarray, least: int, num: int, den: int) -> bool:
    """Whether passages of that similarity can lie here: both hold num / den hits, and one of them the mean share or more."""
    low, mean = num / den, 2 * num / (num + den)
    return has_run(hx, least, low) and has_run(hy, least, low) and (has_run(hx, least, mean) or has_run(hy, least, mean))


def widened(i: int, j: int, n: int, least: int, left: float) -> tuple[int, int]:
    """i..j made `least` long within 0..n-1 where it is shorter, that share of what lacks on the left if there is room."""
    lack = max(0, least - (j - i + 1))
    before = min(i, round(lack * left))
    after = min(n - 1 - j, lack - before)
    return max(0, i - (lack - after)), j + after


def enumerated(x: np.ndarray, y: np.ndarray, kinds: int, least: int, num: int, den: int) -> tuple[int, int, int, int, float] | None:
    """The matching passages that exceed the similarity most, of all bounds that can be best; None if nothing matches.

    A passage of x that is best begins and ends where runs common to both texts do, or is one that was made `least` long.
    For each, whose elements are S, the passage of y is exact: common * den >= num * (S + T - common) holds where the sum
    over y of 1 for a hit and -num / den for a miss reaches S * num / den, so that it is the run of greatest sum among
    those of `least` elements and more. An element that recurs within `least` counts once.
    """
    nx, ny, share = len(x), len(y), num / den
    if min(nx, ny) < least:
        return None
    in_y = held(x, y, kinds)
    follows = np.isin(x[:-1] * kinds + x[1:], y[:-1] * kinds + y[1:])
    begins, ends = np.nonzero(in_y & ~np.append(False, follows))[0], np.nonzero(in_y & ~np.append(follows, False))[0]
    order = np.argsort(y, kind="stable")
    again = np.zeros(ny, bool)
    again[order[1:]] = (y[order[1:]] == y[order[:-1]]) & (order[1:] - order[:-1] < least)
    following, last, tried = np.full(kinds, nx), nx, []
    for i in begins[::-1].tolist():
        following[x[i:last][::-1]] = np.arange(i, last)[::-1]  # where each element occurs first from i on
        last = i
        first = following[x[i:]] == np.arange(i, nx)
        size, common = np.cumsum(first), np.cumsum(first & in_y[i:])
        js = ends[ends >= i]
        js = js[common[js - i] >= share * np.maximum(size[js - i], least * share) - 1e-9]
        place = following[y]
        for k in range(0, len(js), max(1, (1 << 21) // ny)):
            some = js[k : k + max(1, (1 << 21) // ny)]
            weight = np.where(place[None, :] <= some[:, None], 1.0, -share)
            weight[:, again] = 0.0
            sums = np.concatenate([np.zeros((len(some), 1)), np.cumsum(weight, axis=1)], axis=1)
            gain = sums[:, least:] - np.minimum.accumulate(sums[:, : ny + 1 - least], axis=1)
            q = gain.argmax(axis=1)
            margin = gain[np.arange(len(some)), q] - share * np.maximum(size[some - i], least - (some - i + 1) + size[some - i])
            for n in np.nonzero(margin >= -1e-9)[0].tolist():
                tried.append((float(margin[n]), i, int(some[n]), int(np.argmin(sums[n, : q[n] + 1])), int(q[n]) + least - 1))
    for _, i, j, p, q in sorted(tried, reverse=True):
        for left in (0.5, 0.0, 1.0) if j - i + 1 < least else (0.5,):
            a, b = widened(i, j, nx, least, left)
            similarity = similarity_of(x[a : b + 1], y[p : q + 1], kinds, num, den)
            if similarity:
                return a, b, p, q, similarity
    return None


def verify(x: np.ndarray, y: np.ndarray, kinds: int, least: int, num: int, den: int) -> tuple[int, int, int, int, float] | None:
    """The best matching passages of two stretches (bounds in each, similarity), or None.

    The run that gains most is tried first, then the longest one with the hits of that similarity, then runs with ever
    fewer misses, down to none, then equal runs: these are quick, and what they find is a match. A run shorter than a
    passage is widened, for a passage may begin or end with what differs. If they find none, all bounds are tried, from
    either text.
    """
    in_y, tried = held(x, y, kinds), set()
    for best, worth, cost in ((best_stretch, den - num, num), (longest_stretch, den - num, 2 * num), (best_stretch, 1, 20), (best_stretch, 1, 1 << 40)):
        i, j = best(in_y, worth, cost)
        if (i, j) in tried:
            continue
        tried.add((i, j))
        p, q = best(held(y, x[i : j + 1], kinds), worth, cost)
        i2, j2 = best(held(x[i : j + 1], y[p : q + 1], kinds), worth, cost)
        i, j = i + i2, i + j2
        for left in (0.5, 0.0, 1.0) if min(j - i, q - p) + 1 < least else (0.5,):
            (a, b), (c, d) = widened(i, j, len(x), least, left), widened(p, q, len(y), least, left)
            if min(b - a, d - c) + 1 < least:
                continue
            similarity = similarity_of(x[a : b + 1], y[c : d + 1], kinds, num, den)
            if similarity:
                return a, b, c, d, similarity
    run = equal_run(x, y, least)
    if run:
        return (*run, 1.0)
    found = enumerated(x, y, kinds, least, num, den)
    if found is None and (other := enumerated(y, x, kinds, least, num, den)):
        found = (*other[2:4], *other[:2], other[4])
    return found


def verify_all(x: np.ndarray, y: np.ndarray, least: int, num: int, den: int) -> list[tuple[int, int, int, int, float]]:
    """All matching passages of two stretches: what a match leaves of either is verified again.

    What is left of x meets all of y, the passage in x what is left of y. Where hits are too few or too scattered for a
    passage, nothing is tried.
    """
    known, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, kinds = code[: len(x)], code[len(x) :], len(known)
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if min(b - a, d - c) < least:
            continue
        hx = held(x[a:b], y[c:d], kinds)
        if not possible(hx, held(y[c:d], x[a:b], kinds), least, num, den):
            continue
        v = verify(x[a:b], y[c:d], kinds, least, num, den)
        if v:
            i, j, p, q = a + v[0], a + v[1], c + v[2], c + v[3]
            out.append((i, j, p, q, v[4]))
            todo += [(a, i, c, d), (j + 1, b, c, d), (i, j + 1, c, p), (i, j + 1, q + 1, d)]
    return sorted(set(out))


def checker(least: int, num: int, den: int):
    def check(batches):
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            out, seen = [], {}
            for a, b, la, lb, xa, xb in zip(*(cols[n] for n in ("a", "b", "la", "lb", "xa", "xb")), strict=True):
                if (xa, xb) not in seen:  # copies bring equal stretches
                    seen[xa, xb] = verify_all(np.frombuffer(xa, np.uint32), np.frombuffer(xb, np.uint32), least, num, den)
                for v in seen[xa, xb]:
                    out.append((a, la + v[0], la + v[1] + WIDTH - 1, b, lb + v[2], lb + v[3] + WIDTH - 1, v[4]))
            names = ("a", "a_first", "a_last", "b", "b_first", "b_last", "similarity")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64() if k == 6 else pa.int64()) for k in range(7)], names=list(names))

    return check


def sides(found: DataFrame, a: list[str], b: list[str], names: list[str]) -> DataFrame:
    """Both sides of pairs as rows, each once."""
    one = lambda cols: found.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
    return one(a).unionByName(one(b)).distinct()


def verified(table: DataFrame, found: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Matches (a, a_first, a_last, b, b_first, b_last, similarity), written, of the stretches found; a is the later row."""
    found = stash(found)
    want = sides(found, ["a", "la", "ra"], ["b", "lb", "rb"], ["row", "lo", "hi"])
    want = want.select(F.shiftright("row", ROW_BITS).alias("block"), "row", "lo", "hi", F.lit(None).cast("binary").alias("body"))
    # a number for each block at most: the blocks themselves are not shuffled for it
    asked = found.select(F.explode(F.array(F.shiftright("a", ROW_BITS), F.shiftright("b", ROW_BITS))).alias("block")).distinct()
    bodies = table.join(F.broadcast(asked), "block", "left_semi").select("block", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), "body")
    cut = stash(bodies.unionByName(want).groupBy("block").applyInArrow(slicer(), "row long, lo long, hi long, body binary"))
    xa = cut.select(F.col("row").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ra"), F.col("body").alias("xa"))
    xb = cut.select(F.col("row").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("rb"), F.col("body").alias("xb"))
    both = found.join(xa, ["a", "la", "ra"]).join(xb, ["b", "lb", "rb"]).select("a", "b", "la", "lb", "xa", "xb")
    matches = both.mapInArrow(checker(least, num, den), "a long, a_first long, a_last long, b long, b_first long, b_last long, similarity double")
    out = stash(matches.distinct())
    drop(found, cut)
    return out


def meeting(rectangles: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(a, b, la, ca, ra, lb, cb, rb) of the rectangles of a signature that are of two labels and may match, written.

    A signature of many rectangles is cut into tiles. Those of its most frequent label need not meet each other: every tile
    of them meets every tile of the others, and these each other. A rectangle is sent once for each tile that it meets.
    """
    of = rectangles.groupBy("v", "label").count().groupBy("v").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("n"))
    hot = stash(of.where(F.col("n") > TILE).select("v", "major", F.ceil(F.col("most") / TILE).cast("int").alias("ta"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("most")) / TILE)).cast("int").alias("to")))
    number = lambda n: F.pmod(F.xxhash64("row", "lo"), F.col(n)).cast("int")
    to = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = number("to")
    major = F.transform(every("to"), lambda j: to(number("ta"), j, F.lit(0)))
    minor = F.concat(
        F.transform(every("ta"), lambda i: to(i, own, F.lit(1))),
        F.transform(every("to"), lambda j: to(-1 - F.least(own, j), F.greatest(own, j), F.when(j == own, -1).when(own < j, 0).otherwise(1))),
    )
    tiles = F.when(F.col("major").isNull(), F.array(to(F.lit(0), F.lit(0), F.lit(-1)))).when(F.col("label") == F.col("major"), major).otherwise(minor)
    dealt = rectangles.join(hot, "v", "left").select("*", F.explode(tiles).alias("tile")).select(*rectangles.columns, "tile.*")
    groups = max(1, rectangles.count() // MEETING)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("v", "i", "j"), F.lit(groups)))
    met = stash(dealt.groupBy("g").applyInArrow(meeter_of_labels(least, num, den), MET))
    drop(hot)
    return met


def passages_of(matches: DataFrame) -> DataFrame:
    """(row, first, last, passage): every matched run of words; those of a text that overlap are one passage, named by its begin."""
    runs = sides(matches, ["a", "a_first", "a_last"], ["b", "b_first", "b_last"], ["row", "first", "last"])
    w = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("first") > before), F.col("first"))
    return runs.withColumn("begin", begins).withColumn("passage", F.max("begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begin")


def node(row: str, passage: str) -> Column:
    """A passage as one number."""
    return (F.col(row).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col(passage).cast("decimal(12,0)")).cast("decimal(38,0)")


def classes(matches: DataFrame) -> DataFrame:
    """(row, first, last, passage, class): each matched run, where its passage begins, and the least passage that it is connected with."""
    runs = stash(passages_of(matches).withColumn("node", node("row", "passage")))
    side = lambda n: runs.select(F.col("row").alias(n), F.col("first").alias(f"{n}_first"), F.col("last").alias(f"{n}_last"), F.col("node").alias(f"{n}_node"))
    edges = matches.join(side("a"), ["a", "a_first", "a_last"]).join(side("b"), ["b", "b_first", "b_last"]).select("a_node", "b_node").distinct()
    low = components(edges, "a_node", "b_node").withColumnRenamed("node", "n")
    out = stash(runs.join(low, F.col("node") == F.col("n"), "left").select("row", "first", "last", "passage", F.coalesce("component", "node").alias("class")))
    drop(runs)
    return out


def matched(docs: DataFrame, least: int, num: int, den: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, same, m), matches of rows, and their runs with classes."""
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    table = stash(source.mapInArrow(tokenise, "block long, bytes long, body binary"))
    parts = count_parts(table, "bytes")
    bits = min(62, 40 + parts.bit_length())
    asked = table.select("block", "body").mapInArrow(asker(bits, parts, least), HEAD)
    told = stash(asked.groupBy("part").applyInArrow(trim(add_up), HEAD))
    rows = table.select("block", F.lit(-1).alias("part"), "body").unionByName(told)
    out = stash(rows.groupBy("block").applyInArrow(emitter(bits, parts, least, num, den), HEAD))
    ids = stash(out.where("part = -2").groupBy("block").applyInArrow(rows_of, "row long, doc_id long, same long, m long"))
    hubs = stash(out.where("part >= 0").groupBy("part").applyInArrow(trim(elect), HEAD))
    known = stash(out.where("part = -1").unionByName(hubs))
    drop(told, out, hubs)
    early = verified(table, known.groupBy("block").applyInArrow(meeter(bits, parts, least), STRETCHES), least, num, den)

    runs = classes(early)
    of = runs.groupBy("row", "passage").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("class").alias("class"))
    of = of.select(F.shiftright("row", ROW_BITS).alias("block"), "row", "first", "last", F.xxhash64("class").bitwiseAND(F.lit((1 << 63) - 1)).alias("label"))
    labels = stash(known.unionByName(of, allowMissingColumns=True).groupBy("block").applyInArrow(placed(bits, parts, least), HEAD))
    states = labels.where("part >= 0").groupBy("part").applyInArrow(trim(unsettled), HEAD)
    bodies = table.select("block", F.lit(-3).alias("part"), "body")
    rectangles = stash(labels.where("part = -1").unionByName(states).unionByName(bodies).groupBy("block").applyInArrow(opener(bits, parts), OPEN))
    drop(runs, known, labels)
    met = meeting(rectangles, least, num, den)
    drop(rectangles)
    groups = max(1, met.count() // MEANT)
    late = verified(table, met.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(groups))).groupBy("g").applyInArrow(joiner(least), STRETCHES), least, num, den)
    matches = stash(early.unionByName(late).distinct())
    drop(table, met, early, late)
    return ids, matches, classes(matches)


def whole(ids: DataFrame, least: int) -> DataFrame:
    """Texts of which another row is the first, as matches of both from end to end."""
    last, zero = F.col("m") + F.lit(WIDTH - 2), F.lit(0).cast("long")
    copies = ids.where((F.col("row") != F.col("same")) & (F.col("m") >= least))
    return copies.select(F.col("row").alias("a"), zero.alias("a_first"), last.alias("a_last"), F.col("same").alias("b"), zero.alias("b_first"), last.alias("b_last"), F.lit(1.0).alias("similarity"), node("same", "b_first").alias("class"))


def named_classes(found: DataFrame, ids: DataFrame) -> DataFrame:
    """found with the document and first word that name a class in place of its number."""
    word = F.lit(1 << 32).cast("decimal(12,0)")
    found = found.withColumn("c", F.expr("class div cast(4294967296 as decimal(12,0))")).withColumn("class_first", (F.col("class") % word).cast("long"))
    return found.drop("class").join(ids.select(F.col("row").alias("c"), F.col("doc_id").alias("class_id")), "c").drop("c")


def passages(docs: DataFrame, least: int = LEAST, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches (doc_id, first_word, last_word, other_id, other_first, other_last, similarity, class_id, class_first).

    Words count from 0. Passages that are connected by matches have one class, named by the document and first word of
    its first passage. Documents whose shingles all equal those of an earlier one are matched with that one only, with
    similarity 1; their class is the one that begins with it.
    """
    ids, matches, runs = matched(docs, least, num, den, doc_id, text)
    in_class = runs.select(F.col("row").alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), "class")
    found = named_classes(matches.join(in_class, ["b", "b_first", "b_last"]).unionByName(whole(ids, least)), ids)
    name = lambda row, out_: ids.select(F.col("row").alias(row), F.col("doc_id").alias(out_))
    found = found.join(name("a", "doc_id"), "a").join(name("b", "other_id"), "b")
    return found.select("doc_id", F.col("a_first").alias("first_word"), F.col("a_last").alias("last_word"), "other_id", F.col("b_first").alias("other_first"), F.col("b_last").alias("other_last"), "similarity", "class_id", "class_first")


def members(docs: DataFrame, least: int = LEAST, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each repeated passage of each document once, with its class: (doc_id, first_word, last_word, is_copy, class_id, class_first).

    is_copy: the document's shingles all equal those of an earlier one, of which it then has the passages too; its row
    spans it, and so does that of the first.
    """
    ids, _, runs = matched(docs, least, num, den, doc_id, text)
    runs = runs.groupBy("row", "passage").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("class").alias("class")).select("row", "first", "last", "class", F.lit(False).alias("is_copy"))
    copies = whole(ids, least)
    one = lambda n, flag: copies.select(F.col(n).alias("row"), F.col(f"{n}_first").alias("first"), F.col(f"{n}_last").alias("last"), "class", F.lit(flag).alias("is_copy"))
    found = named_classes(runs.unionByName(one("a", True)).unionByName(one("b", False).distinct()), ids)
    return found.join(ids.select("row", "doc_id"), "row").select("doc_id", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "is_copy", "class_id", "class_first")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(documents(spark, sf_dir))


QUERIES = {"op8_compact_windows": op8_compact_windows}
ORACLES: dict[str, str] = {}
