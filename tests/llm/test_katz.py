import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sheafworks.llm import katz


def brute(rows, order, k=katz.KATZ):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    c = [Counter() for _ in range(order + 1)]
    for w, ok in zip(toks, train):
        if ok:
            c[1].update((x,) for x in w)
            full = [" ", *w]
            for m in range(2, order + 1):
                c[m].update(tuple(full[j : j + m]) for j in range(len(full) - m + 1))
    n, v = sum(c[1].values()), len(c[1])
    d = [None] + [katz.discounts(__import__("numpy").array([sum(1 for x in c[m].values() if x == r) for r in range(1, k + 2)])) for m in range(1, order + 1)]
    disc = lambda m, x: x * (d[m][x] if x <= k else 1.0)
    lost = n - sum(disc(1, x) for x in c[1].values())
    total = n if lost > 1e-9 else n + 1
    by = [defaultdict(list) for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, x in c[m].items():
            by[m][g[:-1]].append((g[-1], x))

    def p(h, w):
        m = len(h) + 1
        if m == 1:
            x = c[1].get((w,), 0)
            return disc(1, x) / total if x else 1 - (n - lost) / total if n else 1.0
        low = p(h[1:], w)
        seen = by[m].get(h, ())
        if not seen:
            return low
        nh = sum(x for _, x in seen)
        less = nh - sum(disc(m, x) for _, x in seen)
        used = nh if less > 1e-9 else nh + 1
        x = c[m].get((*h, w), 0)
        if x:
            return disc(m, x) / used
        return (1 - sum(disc(m, x) for _, x in seen) / used) / (1 - sum(p(h[1:], u) for u, _ in seen)) * low

    out = []
    for (i, _), w, ok in zip(rows, toks, train):
        full, s = [" ", *w], 0.0
        for j in range(1, len(full)):
            s += math.log10(p(tuple(full[max(0, j - order + 1) : j]), full[j]))
        base = sum(math.log10((c[1].get((x,), 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, not ok, len(w), sum((x,) in c[1] for x in w), n, base, s))
    return out, p, c


def texts():
    import random

    r = random.Random(3)
    words = ["a", "b", "the", "The", "of", "x1", "é", "zz", "long" * 40]
    rows = [(i, " ".join(r.choice(words[: 2 + i % 8]) for _ in range(i % 23))) for i in range(120)]
    return [*rows, (None, None), (500, ""), (501, "\t \n"), (3, rows[3][1]), (3, rows[3][1]), (777, "new words only here"), (778, "a b " * 3000)]


@pytest.mark.parametrize("order, parts, hot", [(1, 1, 10**6), (2, 1, 10**6), (3, 1, 10**6), (2, 7, 20), (3, 5, 3), (4, 3, 2)])
def test_scores_match_brute_force(spark, monkeypatch, order, parts, hot):
    """Also with several blocks, partitions and contexts dealt in shares."""
    monkeypatch.setattr(katz, "count_parts", lambda table, name: parts)
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, part int").repartition(3 * parts)
    got = katz.score(df, order, hot).collect()
    want, _, _ = brute(rows, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("hot", [10**6, 5])
def test_contexts_add_up_to_one(spark, monkeypatch, hot):
    """The engine's own tables: in each context the seen n-grams and alpha times the lower level's rest are 1."""
    monkeypatch.setattr(katz, "count_parts", lambda table, name: 3)
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(4)
    model, words, grams, contexts = katz.model_tables(df, 3, hot)
    level1 = {r.word: model.unigram(r["count"]) for r in words.collect()}
    assert sum(level1.values()) + model.unseen == pytest.approx(1)
    low, seen = {}, defaultdict(dict)
    for r in grams.collect():
        seen[r.level, r.context][r.word] = (r["count"], r.ngram)
    of = {(r.level, r.context): r for r in contexts.collect() if r.n}
    assert set(of) == set(seen) and len(of) > 10
    probability, suffix = {}, {}
    for level in (2, 3):
        for (k, h), follow in seen.items():
            if k != level:
                continue
            r = of[k, h]
            kept = {w: c * (model.d[k - 1][c] if c <= katz.KATZ else 1) / r.used for w, (c, _) in follow.items()}
            if level == 2:
                rest = 1 - sum(level1[w] for w in follow)
                for w, (_, ngram) in follow.items():
                    suffix[ngram] = w
                low[h] = (kept, r.alpha)
            else:
                backed, alpha = low[suffix[h]]  # the context's last word
                rest = 1 - sum(backed.get(w, alpha * level1[w]) for w in follow)
            assert sum(kept.values()) + r.alpha * rest == pytest.approx(1)
            assert r.n == sum(c for c, _ in follow.values()) and 0 <= r.alpha


def test_held_out_texts_gain_by_order(spark):
    """Held-out texts score better with bigrams than with single words."""
    import random

    r = random.Random(1)
    follow = {f"w{k}": [f"w{r.randrange(50)}" for _ in range(3)] for k in range(50)}

    def text():
        w = ["w0"]
        for _ in range(40):
            w.append(r.choice(follow[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    by = [sum(x.score for x in katz.score(df, order).collect() if x.held_out) for order in (1, 2)]
    assert by[1] > 0.6 * by[0]


def test_empty_table(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
