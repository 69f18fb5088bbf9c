"""N-gram join against brute force over all pairs."""

import random
import re

import duckdb
import numpy as np
import pytest

from spendlake.llm import common, ngram_join
from spendlake.llm.queries import ORACLE, op2_ngram_join

U = np.uint64


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, num, den):
    """(id, n_shingles, component id) of each row, all pairs of different sets compared."""
    key = lambda d: 2**63 - 1 if d is None else d
    sets = [shingles(t, k) for _, t in rows]
    parent = {key(d): key(d) for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s:
            a, b = find(key(d)), find(first.setdefault(s, key(d)))
            parent[max(a, b)] = min(a, b)
    some = sorted(first, key=len)
    where = {}
    for i, s in enumerate(some):
        for j in {j for x in s for j in where.get(x, ())}:
            c = len(s & some[j])
            if den * c >= num * (len(s) + len(some[j]) - c):
                a, b = find(first[s]), find(first[some[j]])
                parent[max(a, b)] = min(a, b)
        for x in s:
            where.setdefault(x, []).append(i)
    real = lambda x: None if x == 2**63 - 1 else x
    return sorted(str((d, len(s), real(find(key(d))) if s else d)) for (d, _), s in zip(rows, sets, strict=True))


def check(spark, rows, k=4, num=85, den=100):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, n int")
    got = ngram_join.components(docs, k, num, den).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, k, num, den)
    return got


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_key_and_pass_the_filter(num, den):
    plan = ngram_join.Plan(4, num, den)
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 120)) if rng.random() < 0.9 else int(rng.integers(300, 900))
        x = np.unique(rng.integers(0, 2**64, n, dtype=U))
        drop, add = rng.integers(0, max(1, n // 3) + 1, 2)
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, n - drop)], rng.integers(0, 2**64, add, dtype=U)]))
        c = len(np.intersect1d(x, y))
        if not plan.linked(c, len(x), len(y)) or np.array_equal(x, y):
            continue
        linked += 1
        share = rng.random()  # of frequent shingles
        often = lambda s, p=share: (s % U(997)).astype(float) / 997 < p
        assert len(np.intersect1d(plan.keys(x, often(x)), plan.keys(y, often(y)))), (len(x), len(y), c)
        bx, by = ngram_join.bitmap(x), ngram_join.bitmap(y)
        width = min(len(bx), len(by))
        dist = int(np.bitwise_count(ngram_join.fold(bx, width) ^ ngram_join.fold(by, width)).sum())
        assert dist <= len(x) + len(y) - 2 * c
    assert linked > 300


def test_packed_tokens_come_back():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, dtype=U))
    assert np.array_equal(ngram_join.unpack(ngram_join.pack(x)), x >> U(16))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (5, 5), (9, 8), (8, 7), (20, 10), (None, 4), (30, 31)] + [(i, i + 1) for i in range(100, 160)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 30, 31: 30} | {i: 100 for i in range(100, 161)}
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_copies(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                t = passage + t
            rows.append((len(rows) * 3 + g % 2, " ".join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (3, 60, 100)])
def test_near_copies(spark, k, num, den):
    check(spark, near_copies(), k, num, den)


def test_odd_rows(spark):
    t = " ".join(f"q{i}" for i in range(50))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (9, t), (8, t.upper()), (8, t.upper()), (7, t + " end"), (None, t + " end more")]
    rows += [(None, "left alone here by itself"), (20, "text a b c d e"), (20, "another text of twenty"), (21, "another text of twenty"), (22, "text a b c d e")]
    rows += [(40, "x y " * 40_000), (41, "x y " * 39_000), (50, "É é"), (51, "é É")]
    check(spark, rows)


def test_a_large_group_in_which_few_pairs_link(spark):
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = check(spark, rows)
    assert len({x.component_id for x in got}) > 5


def passages(seed=3):
    """Documents made of the same shared passages, near copies of several groups among them."""
    r = random.Random(seed)
    base = [[f"p{g}_{i}" for i in range(120)] for g in range(3)]
    rows = []
    for i in range(330):
        t = list(base[i % 3]) + base[0][: r.choice([0, 0, 10])]
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [16, 40])
def test_no_task_holds_more_of_a_key_than_two_blocks(spark, block):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components(docs, block=block).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 4, 85, 100)
    plan = ngram_join.Plan(4, 85, 100)
    sets = {d: ngram_join.shingle_set(t, 4) for d, t in rows}
    keys = [(d, len(s), [int(x) for x in plan.keys(s, np.ones(len(s), bool)).view(np.int64)]) for d, s in sets.items()]
    index = spark.createDataFrame(keys, "did long, n long, keys array<long>")
    cold, hot = ngram_join._shared_keys(index, block)
    assert cold.groupBy("key").count().where(f"count >= {block}").isEmpty()
    assert hot.groupBy("block").count().where(f"count > {block}").isEmpty()
    owners = {}
    for d, _, ks in keys:
        for k in set(ks):
            owners.setdefault(k, set()).add(d)
    big = {k: v for k, v in owners.items() if len(v) >= block}
    assert max(map(len, big.values())) > 3 * block // 2
    rows = hot.withColumn("comp", ngram_join.F.col("did"))
    where = {}
    for r in hot.collect():
        where.setdefault(r.block, set()).add((r.key, r.did))
    units = {}
    for r in ngram_join._block_pairs(rows, plan).collect():
        units.setdefault(r.key, [None, None])[r.side] = r.block
    compared = set()
    for i, j in units.values():
        for k, x in where[i]:
            compared |= {(k, *sorted((x, y))) for _, y in where[i if j is None else j] if x != y}
    near = lambda x, y: 100 * min(len(sets[x]), len(sets[y])) >= 85 * max(len(sets[x]), len(sets[y]))
    assert all((k, x, y) in compared for k, v in big.items() for x in v for y in v if x < y and near(x, y))


def test_empty_table(spark):
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 4, 85, 100)
    assert sorted(str(tuple(r)) for r in op2_ngram_join(spark, sf).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(str, con.execute(ORACLE["op2_ngram_join"]).fetchall())) == want


def test_word_hashes():
    rnd = random.Random(9)
    letters = ["a", "A", "b", "é", "日", "\u00a0", "\x1c", "\0"]
    texts = [None, "", " \t\n\x0b\x0c\r", "x" * 2000 + " " + "X" * 2000, "ab " * 9]
    texts += ["".join(rnd.choice([*letters, " ", "\n", "  "]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    raw = [t if t is None else t.encode() for t in texts]
    words = [(t or b"").lower().split() for t in raw]
    h, ends = ngram_join.word_hashes(raw)
    assert ends.tolist() == [sum(map(len, words[: i + 1])) for i in range(len(words))]
    flat = [w for ws in words for w in ws]
    seen = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
