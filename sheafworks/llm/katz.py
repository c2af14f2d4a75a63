"""Language-model scoring: Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

Documents are cut into blocks of bounded size; a block tokenises its texts and asks about each of its distinct n-grams
once. Questions carry the block's training counts and go, packed, to the partition of their context; there all blocks'
counts are added up, which gives the model's partitioned table (written; `model_tables` shows it as columns) and the
answers that go back to the blocks. A context seen more than HOT times is dealt by its words to several partitions; its
sums are added up in a second step and joined to the blocks that have it. Order by order the next level's questions are
built on the answers of the last. Nothing of the model passes the driver but counts of counts (some numbers for each level).

Probabilities. Level 1: d(c) c / N for seen words, the rest of the mass for the one event "unseen word". Level m: for a
seen n-gram d(c) c / n(h), else alpha(h) times level m-1, alpha(h) = (1 - mass of the seen) / (1 - lower mass of the
seen); d(c) is Katz's discount for c <= 5 and 1 above. Where counts of counts allow no discount, (c - 1/2) / c is used;
where a context's seen n-grams would keep all its mass, n(h) + 1 replaces n(h), which leaves 1 / (n(h) + 1) for the
unseen. So each context's probabilities add up to 1. A text's first word has the end token as its context.

Defined cases: a null text is empty and scores its end token; a null id counts as the id ''; equal rows are scored
(and, if training, counted) each; a table without training rows gives the unseen event probability 1; columns other
than id and text play no part; a text larger than a block is a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm.common import block_id, blocks, column, count_parts, documents, gaps, give_back, named, pack, part_of, runs_of, stash, trim, unpack, words_of

KATZ = 5  # counts up to this one are discounted
END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a blank
ORDER = 2
#: Occurrences of a context that one partition takes; a step between the partitions of its shares.
HOT, STEP = 100_000, 2654435761
#: Questions and answers by block; a partition's own rows (no block): its table and counts of counts, its shares of hot contexts.
ASKING = "block long, part int, body binary"
ANSWERS = "block long, part int, body binary, stats array<long>, needs array<long>, share array<double>"


def in_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def tokenise(batches):
    """Blocks: ids, flags, words of each text as numbers of the block's vocabulary (END is 0), its hashes in order."""
    for k, t in enumerate(blocks(batches)):
        words, counts = words_of(column(t, "text"))
        coded = words.dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64) + 1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in pc.cast(coded.dictionary, pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        tokens = np.insert(codes, np.cumsum(counts), 0)
        hashes = np.concatenate([np.array([END], np.uint64), hashes])
        order = np.argsort(hashes)
        ids = column(t, "doc_id")
        train = np.fromiter(map(in_training, ids.to_pylist()), bool, len(ids))
        body = pack(tokens=tokens, n=counts + 1, train=train.astype(np.uint8), ids=pc.fill_null(ids, 0).to_numpy().astype(np.int64), null=np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), order=order)
        raw = int(pc.sum(pc.binary_length(column(t, "text"))).as_py() or 0)
        yield pa.RecordBatch.from_arrays([pa.array([block_id(k)], pa.int64()), pa.array([raw], pa.int64()), pa.array([body], pa.binary()), pa.array([pack(words=hashes[order])], pa.binary())], names=["block", "bytes", "body", "vocabulary"])
        give_back()


def discounts(of: np.ndarray) -> np.ndarray:
    """d(1..KATZ) from the numbers of n-grams seen 1..KATZ+1 times; index 0 unused."""
    d = np.ones(KATZ + 1)
    n = np.concatenate([[0], of.astype(float)])
    tail = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c; d[0] is 1, for counts above KATZ."""
    return d[np.where(c <= KATZ, c, 0)] * c


class Model:
    """What is known of the levels that are done: partitions, discounts, totals. Some numbers, sent with the code."""

    def __init__(self, parts: int, hot: int):
        self.parts, self.hot, self.d = parts, hot, []
        self.n_train = self.kinds = self.spread = 0
        self.total, self.unseen = 1.0, 1.0

    def learn(self, of: list[int], n: int, kinds: int, spread: int) -> None:
        """The counts of counts of the next level; of the first level also its totals."""
        self.d.append(discounts(np.array(of)))
        if len(self.d) == 1:
            self.n_train, self.kinds, self.spread = n, kinds, spread
            lost = float((np.array(of[:KATZ]) * np.arange(1, KATZ + 1) * (1 - self.d[0][1:])).sum())
            if n:
                self.total = float(n) if lost > 1e-9 else n + 1.0
                self.unseen = 1 - (n - lost) / self.total

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d[0]) / self.total, self.unseen)

    def context(self, level: int, n: np.ndarray, few: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The divisor and alpha of contexts, from n(h), its n-grams seen 1..KATZ times, and the lower mass of the seen."""
        lost = few @ (np.arange(1, KATZ + 1) * (1 - self.d[level - 1][1:]))
        used = np.where(lost > 1e-9, n, n + 1.0)
        alpha = np.where(n > 0, (1 - (n - lost) / used) / (1 - lower), 1.0)
        return used, alpha


class Block:
    """A block's tokens, and what the answers so far say of them. Words and contexts have dense numbers, -1 if unseen."""

    def __init__(self, t: pa.Table, model: Model, upto: int):
        by: dict[int, dict[int, bytes]] = {}
        for level, part, body in zip(t.column("level").to_pylist(), t.column("part").to_pylist(), t.column("body").to_pylist(), strict=True):
            by.setdefault(level, {})[part] = body
        self.raw, self.model = unpack(by[0][0]), model
        self.tokens, self.n = self.raw["tokens"].astype(np.int64), self.raw["n"].astype(np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.trained = np.repeat(self.raw["train"].astype(np.int64), self.n)
        if upto:
            self.words(by[1])
        for level in range(2, upto + 1):
            self.evaluate(level, by.get(level, {}))

    def ask_words(self, vocabulary: bytes):
        """The vocabulary is sorted by hash, partitions are ranges of it."""
        words = unpack(vocabulary)["words"]
        trained = np.bincount(self.tokens, weights=self.trained, minlength=len(words)).astype(np.int64)[self.raw["order"]]
        for p, i, j in runs_of(part_of(words, 64, self.model.parts)):
            yield p, pack(h=gaps(words[i:j]), trained=trained[i:j])

    def words(self, answers: dict[int, bytes]) -> None:
        got = [unpack(body) for _, body in sorted(answers.items())]
        order = self.raw["order"].astype(np.int64)
        self.count, self.number = np.zeros(len(order), np.int64), np.full(len(order), -1)
        self.count[order] = np.concatenate([x["c"] for x in got])
        self.number[order] = np.concatenate([x["number"] for x in got])
        self.c, self.w = self.count[self.tokens], self.number[self.tokens]
        self.p = self.model.unigram(self.c)
        self.h, self.seen = self.before(self.w, self.number[0]), self.before(self.c, self.count[0])

    def before(self, values: np.ndarray, first: int) -> np.ndarray:
        h = np.concatenate([[first], values[:-1]]).astype(np.int64)
        h[self.starts] = first
        return h

    def grams(self) -> dict[str, np.ndarray]:
        """This level's distinct contexts, or shares of hot ones, by partition, and under each its distinct seen words.

        A context's share is its words with one remainder; how many shares there are follows from its count, which all
        blocks know alike."""
        parts = self.model.parts
        has = np.nonzero(self.h >= 0)[0]
        u, inv = np.unique(self.h[has], return_inverse=True)
        known = self.w[has] >= 0
        share = np.where(known, self.w[has] % (1 + self.seen[has] // self.model.hot), 0)
        most = int(share.max(initial=0)) + 1
        unit, inv = np.unique(inv * most + share, return_inverse=True)
        ctx, share = u[unit // most], unit % most
        part = (ctx + share * STEP) % parts
        order = np.lexsort((share, ctx // parts, part))
        rank = np.empty(len(unit), np.int64)
        rank[order] = np.arange(len(unit))
        inv, ctx, share, part = rank[inv], ctx[order], share[order], part[order]
        hot = np.zeros(len(ctx), bool)
        hot[inv] = self.seen[has] >= self.model.hot
        key, first, pair = np.unique(inv[known] * np.int64(self.model.spread + 1) + self.w[has][known], return_index=True, return_inverse=True)
        of = key // (self.model.spread + 1)
        n = np.bincount(of, minlength=len(ctx))
        ends = np.concatenate([[0], np.cumsum(n)])
        return {"has": has, "ctx": ctx, "share": share, "hot": hot, "inv": inv, "at": has[known], "pair": pair, "of": of, "w": key % (self.model.spread + 1), "first": has[known][first], "k": n, "runs": [(p, i, j, ends[i], ends[j]) for p, i, j in runs_of(part)]}

    def ask(self, level: int):
        g = self.grams()
        trained = np.bincount(g["pair"], weights=self.trained[g["at"]], minlength=len(g["w"])).astype(np.int64)
        lower = self.c[g["first"]] if level == 2 else self.p[g["first"]]
        for p, i, j, a, b in g["runs"]:
            shares = {"share": g["share"][i:j], "hot": g["hot"][i:j].astype(np.uint8)} if g["hot"][i:j].any() else {}
            yield p, pack(h=gaps(g["ctx"][i:j] // self.model.parts), k=g["k"][i:j], w=g["w"][a:b], trained=trained[a:b], lower=lower[a:b], **shares)

    def evaluate(self, level: int, answers: dict[int, bytes]) -> None:
        g = self.grams()
        n, lower, few = np.zeros(len(g["ctx"])), np.zeros(len(g["ctx"])), np.zeros((len(g["ctx"]), KATZ))
        c, number = np.zeros(len(g["w"]), np.int64), np.full(len(g["w"]), -1)
        for p, i, j, a, b in g["runs"]:
            x = unpack(answers[p])
            n[i:j], lower[i:j], few[i:j], c[a:b] = x["n"], x["lower"], x["few"].reshape(KATZ, -1).T, x["c"]
            if "number" in x:
                number[a:b] = x["number"]
        if g["hot"].any():
            x, i = unpack(answers[-1]), np.nonzero(g["hot"])[0]
            k = np.searchsorted(x["ctx"], g["ctx"][i])
            n[i], lower[i], few[i] = x["n"][k], x["lower"][k], x["few"].reshape(-1, KATZ)[k]
        used, alpha = self.model.context(level, n, few, lower)
        p = self.p.copy()
        p[g["has"]] *= alpha[g["inv"]]
        seen = c[g["pair"]] > 0
        at, of = g["at"][seen], g["pair"][seen]
        p[at] = discounted(c, self.model.d[level - 1])[of] / used[g["of"][of]]
        self.p = p
        numbers, counts = np.full(len(self.tokens), -1), np.zeros(len(self.tokens), np.int64)
        numbers[g["at"]], counts[g["at"]] = number[g["pair"]], c[g["pair"]]
        self.h, self.seen = self.before(numbers, -1), self.before(counts, 0)

    def scores(self) -> pa.Table:
        m = self.model
        total = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  every text has its end token
        base = np.log10((self.c + 0.5) / (m.n_train + 0.5 * (m.kinds + 1)))
        ids = pa.array(self.raw["ids"].astype(np.int64), mask=self.raw["null"].astype(bool))
        cols = {"doc_id": ids, "held_out": self.raw["train"] == 0, "n_tokens": self.n, "n_known": total((self.c > 0).astype(np.int64)), "train_tokens": np.full(len(self.n), m.n_train, np.int64), "base_score": total(base), "score": total(np.log10(self.p))}
        return pa.table({k: pa.array(v) for k, v in cols.items()})


def add_words(t: pa.Table, parts: int) -> pa.Table:
    """One partition of the vocabulary: all blocks' counts added up."""
    got = [unpack(b) for b in t.column("body").to_pylist()]
    words = [np.cumsum(x["h"].astype(np.uint64), dtype=np.uint64) for x in got]
    u, inv = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(inv, weights=np.concatenate([x["trained"] for x in got]), minlength=len(u)).astype(np.int64)
    part = t.column("part")[0].as_py()
    number = np.where(c > 0, (np.cumsum(c > 0) - 1) * parts + part, -1)
    cut = np.split(inv, np.cumsum([len(w) for w in words])[:-1])
    return answered(t, [pack(c=c[i], number=number[i]) for i in cut], pack(hash=u[c > 0], number=number[c > 0], c=c[c > 0]), c)


def add_grams(t: pa.Table, model: Model, level: int, last: bool) -> pa.Table:
    """One partition of a level's table: all blocks' counts of its contexts' n-grams added up, contexts summed up."""
    part, wide = t.column("part")[0].as_py(), model.spread + 1
    got = [unpack(b) for b in t.column("body").to_pylist()]
    own = lambda x, k: x[k].astype(np.int64) if k in x else np.zeros(len(x["h"]), np.int64)
    shares, hots = ([own(x, k) for x in got] for k in ("share", "hot"))
    most = max(int(x.max(initial=0)) for x in shares) + 1
    units = [np.cumsum(x["h"], dtype=np.int64) * most + j for x, j in zip(got, shares, strict=True)]
    unit, inv = np.unique(np.concatenate(units), return_inverse=True)
    hot = np.zeros(len(unit), bool)
    hot[inv] = np.concatenate(hots) > 0
    ctx = unit // most * model.parts + (part - unit % most * STEP) % model.parts
    cut = np.cumsum([len(x) for x in units])[:-1]
    keys = [np.repeat(i, x["k"]) * wide + x["w"] for i, x in zip(np.split(inv, cut), got, strict=True)]
    u, where = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(where, weights=np.concatenate([x["trained"] for x in got]), minlength=len(u)).astype(np.int64)
    low = np.zeros(len(u))
    lower = np.concatenate([x["lower"] for x in got])
    low[where] = model.unigram(lower.astype(np.int64)) if level == 2 else lower
    # sums by context over the n-grams that training saw; number and few are of those seen r times
    of, some = u // wide, c > 0
    add = lambda x: np.bincount(of[some], weights=x, minlength=len(unit))
    n, mass, few = add(c[some]).astype(np.int64), add(low[some]), np.stack([add(c[some] == r).astype(np.int64) for r in range(1, KATZ + 1)])
    number = np.where(some, (np.cumsum(some) - 1) * model.parts + part, -1)
    out, needs = [], []
    for i, k in zip(np.split(inv, cut), np.split(where, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
        out.append(pack(n=n[i], lower=mass[i], few=few[:, i].ravel(), c=c[k], **({} if last else {"number": number[k]})))
        needs.append(ctx[i[hot[i]]].tolist() or None)
    table = pack(context=ctx[of[some]], word=u[some] % wide, number=number[some], c=c[some], ctx=ctx[~hot], n=n[~hot], lower=mass[~hot], few=few[:, ~hot].T.ravel())
    return answered(t, out, table, c, needs, [[float(x) for x in (ctx[k], n[k], mass[k], *few[:, k])] for k in np.nonzero(hot)[0]])


def answered(t: pa.Table, answers: list[bytes], model: bytes, c: np.ndarray, needs: list | None = None, shares: list | None = None) -> pa.Table:
    """The blocks' answers, and the partition's own rows (no block)."""
    stats = [int((c == r).sum()) for r in range(1, KATZ + 2)] + [int(c.sum()), int((c > 0).sum())]
    n, shares = t.num_rows, shares or []
    part = t.column("part")[0].as_py()
    more = [None] * len(shares)
    return pa.table({
        "block": pa.array([*t.column("block").to_pylist(), None, *more], pa.int64()), "part": pa.array([part] * (n + 1 + len(shares)), pa.int32()), "body": pa.array([*answers, model, *more], pa.binary()),
        "stats": pa.array([*[None] * n, stats, *more], pa.list_(pa.int64())), "needs": pa.array([*(needs or [None] * n), None, *more], pa.list_(pa.int64())), "share": pa.array([*[None] * (n + 1), *shares], pa.list_(pa.float64())),
    })


def sums_of(t: pa.Table) -> pa.Table:
    """A block's hot contexts with their sums, as one more answer."""
    t = t.sort_by("ctx")
    few = np.stack([column(t, f"few{r}").to_numpy() for r in range(1, KATZ + 1)], axis=1)
    body = pack(ctx=column(t, "ctx").to_numpy(), n=column(t, "n").to_numpy(), lower=column(t, "lower").to_numpy(), few=few.ravel())
    return pa.table({"block": t.column("block").slice(0, 1), "part": pa.array([-1], pa.int32()), "body": pa.array([body], pa.binary())})


def asker(model: Model, level: int):
    def ask(t: pa.Table) -> pa.Table:
        b = Block(t, model, level - 1)
        asked = list(b.ask_words(t.column("vocabulary")[0].as_py()) if level == 1 else b.ask(level))
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(asked), pa.int64()), "part": pa.array([p for p, _ in asked], pa.int32()), "body": pa.array([x for _, x in asked], pa.binary())})

    return trim(ask)


def one_by_one(ask):
    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(k, 1)])).to_batches()

    return each


def adder(model: Model, level: int, last: bool):
    def add(t: pa.Table) -> pa.Table:
        return add_words(t, model.parts) if level == 1 else add_grams(t, model, level, last)

    return trim(add)


def scorer(model: Model, order: int):
    def run(t: pa.Table) -> pa.Table:
        return Block(t, model, order).scores()

    return trim(run)


def hot_contexts(done: DataFrame) -> DataFrame:
    """(ctx, n, lower, few1, ...) of the contexts that were dealt in shares, added up."""
    item = lambda i: F.sum(F.col("share")[i])
    few = [item(3 + r).cast("long").alias(f"few{r + 1}") for r in range(KATZ)]
    return done.where("share is not null").groupBy(F.col("share")[0].cast("long").alias("ctx")).agg(item(1).cast("long").alias("n"), item(2).alias("lower"), *few)


def train(docs: DataFrame, order: int, hot: int, doc_id: str, text: str) -> tuple[Model, DataFrame, list[DataFrame]]:
    """The model, the blocks with all answers, and each level's table of answers."""
    source = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    table = stash(source.mapInArrow(tokenise, "block long, bytes long, body binary, vocabulary binary"))
    model = Model(count_parts(table, "bytes"), hot)
    head = ["block", F.lit(0).alias("level"), F.lit(0).alias("part"), "body"]
    rows, levels = table.select(*head), []

    for level in range(1, order + 1):
        ask, add = asker(model, level), adder(model, level, level == order)
        asked = table.select(*head, "vocabulary").mapInArrow(one_by_one(ask), ASKING) if level == 1 else rows.groupBy("block").applyInArrow(ask, ASKING)
        done = stash(asked.groupBy("part").applyInArrow(add, ANSWERS))
        s = done.agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(KATZ + 3)], F.coalesce(F.max(F.col("stats")[KATZ + 2]), F.lit(0))).first()
        model.learn(list(s[: KATZ + 1]), s[KATZ + 1], s[KATZ + 2], s[KATZ + 3] * model.parts)
        levels.append(done)
        answers = done.where("block is not null").select("block", "part", "body")
        if level > 1:
            needs = done.where("needs is not null").select("block", F.explode("needs").alias("ctx")).distinct()
            answers = answers.unionByName(needs.join(hot_contexts(done), "ctx").groupBy("block").applyInArrow(sums_of, ASKING))
        rows = rows.unionByName(answers.select("block", F.lit(level).alias("level"), "part", "body"))
    return model, rows, levels


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents."""
    model, rows, _ = train(docs, order, hot, doc_id, text)
    return rows.groupBy("block").applyInArrow(scorer(model, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model_tables(docs: DataFrame, order: int = ORDER, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model's discounts, and its tables: words (word, hash, count), n-grams (level, ngram, context, word, count), and
    contexts (level, context, n, used, lower, alpha). A word's context of level 2 is its number, one of level 3 the number
    of its n-gram of level 2; the unseen word has the probability `unseen` of the model."""
    model, _, levels = train(docs, order, hot, doc_id, text)
    own = lambda done: done.where("block is null and body is not null").select("body")

    def unpacked(names: list[str], fields: list[str]):
        def rows(batches):
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    x = unpack(body)
                    yield pa.RecordBatch.from_arrays([pa.array(x[f].view(np.int64) if f == "hash" else x[f].astype(np.int64)) for f in fields], names=names)

        return rows

    def contexts(level: int):
        def rows(batches):
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    x = unpack(body)
                    n, lower, few = x["n"].astype(np.int64), x["lower"].astype(float), x["few"].reshape(-1, KATZ)
                    used, alpha = model.context(level, n, few, lower)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["ctx"].astype(np.int64), n, used.astype(float), lower, alpha.astype(float))], names=["context", "n", "used", "lower", "alpha"])

        return rows

    words = own(levels[0]).mapInArrow(unpacked(["word", "hash", "count"], ["number", "hash", "c"]), "word long, hash long, count long")
    none = words.limit(0)
    grams = none.select(F.lit(0).alias("level"), F.col("word").alias("ngram"), F.col("word").alias("context"), "word", "count")
    kept = none.select(F.lit(0).alias("level"), F.col("word").alias("context"), F.col("word").alias("n"), *[F.lit(0.0).alias(c) for c in ("used", "lower", "alpha")])
    for level, done in list(enumerate(levels, 1))[1:]:
        names = ["ngram", "context", "word", "count"]
        grams = grams.unionByName(own(done).mapInArrow(unpacked(names, ["number", "context", "word", "c"]), ", ".join(f"{c} long" for c in names)).withColumn("level", F.lit(level)))
        packed = own(done).unionByName(hot_contexts(done).withColumn("block", F.lit(0).cast("long")).withColumn("k", F.col("ctx")).groupBy("k").applyInArrow(sums_of, ASKING).select("body"))
        kept = kept.unionByName(packed.mapInArrow(contexts(level), "context long, n long, used double, lower double, alpha double").withColumn("level", F.lit(level)))
    return model, words, grams, kept


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op1_katz": op1_katz}
ORACLES: dict[str, str] = {}
