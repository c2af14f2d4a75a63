import hashlib
import random

import numpy as np
import pytest

from sheafworks.llm import common, suffixes


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (rows[k][0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return list(out.values())


def test_names_are_sorted():
    """Strings of many rare names, of long rises and falls, and of periods."""
    r = np.random.default_rng(3)
    rare = [r.integers(0, 90, r.integers(1, 120)) for _ in range(200)]
    slopes = [np.concatenate([np.arange(30), np.arange(40)[::-1]] * int(k)) for k in (1, 2, 5)]
    periods = [np.tile(r.integers(0, 3, r.integers(1, 9)), 12) for _ in range(200)]
    for t in [*rare, *slopes, *periods]:
        t = np.unique(t, return_inverse=True)[1]
        assert suffixes.sorted_names(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_is_sorted():
    r = random.Random(1)
    for _ in range(300):
        s = bytes(r.choice(b"ab\x01c"[: r.randint(1, 4)]) for _ in range(r.randint(1, 80)))
        t = np.frombuffer(s, np.uint8).astype(np.int64)
        sa = suffixes.suffix_array(t)
        assert suffixes.sorted_names(t).tolist() == sa.tolist()
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffixes.common_prefixes(t, sa)
        for k in range(1, len(s)):
            a, b = s[sa[k - 1] :], s[sa[k] :]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def corpus():
    r = random.Random(5)
    words = ["alpha", "beta", "é", "gamma", "x", "日本", "tau"]
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(n))
    base, passage = text(120), text(40)
    rows = [(i, text(r.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, base if i % 3 else base[: 200 + i] + "!" + base[205 + i :]) for i in range(30)]
    rows += [(200 + i, text(5) + passage + text(5)) for i in range(20)]
    rows += [(300, "a" * 500), (301, "ab" * 300), (302, "a" * 99), (303, ""), (304, None), (305, text(4000)), (306, passage + passage), (None, base), (100, base)]
    return rows


@pytest.mark.parametrize("small, hot", [(False, 10**6), (True, 10**6), (True, 1), (True, 12)])
def test_spans_match_brute_force(spark, monkeypatch, small, hot):
    rows = corpus()
    if small:  # many blocks and partitions of the exchange
        monkeypatch.setattr(suffixes, "count_parts", lambda table, name: common.count_parts(table, name, 2000))
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 13), "doc_id long, text string")
    else:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, suffixes.spans(df, hot=hot).collect()), key=repr)
    assert got == sorted(brute(rows, 100), key=repr)


def test_strip_keeps_other_columns(spark):
    rows = corpus()
    clash = "doc_id long, text string, block string, body int, _text string, _id int, _removed int, rest int, none string, `a.b` int"
    df = spark.createDataFrame([(i, t, "s", k, "x", 1, 2, 3, None, 4) for k, (i, t) in enumerate(rows)], clash).coalesce(1)
    out = suffixes.strip(df)
    assert out.columns == df.columns
    got = {r["body"]: r for r in out.collect()}
    want = brute(rows, 100)
    assert set(got) == {k for k, (i, n, lost, _, _) in enumerate(want_in_order(rows, want)) if not n or lost < n}
    assert all((r["block"], r["_text"], r["_id"], r["_removed"], r["rest"], r["none"], r["a.b"]) == ("s", "x", 1, 2, 3, None, 4) for r in got.values())


def want_in_order(rows, want):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    back = {k: w for k, w in zip(order, want)}
    return [back[k] for k in range(len(rows))]


def test_empty_table(spark):
    assert suffixes.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
