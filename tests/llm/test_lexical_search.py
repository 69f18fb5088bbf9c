"""Ranked lexical search against a brute-force version and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from spendlake.llm import lexical_search as ls
from spendlake.llm.queries import ORACLE, op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, n_all = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    queries = {}
    for i, t in items:
        queries.setdefault(i, []).extend(cut(t))
    out = []
    for i, q in queries.items():
        got = []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_all
            score = 0
            for t in q:
                if b[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                got.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(got, key=lambda x: x[:3])[:k])]
    return Counter(out)


def run(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, item_id string, score int, rank int").repartition(3)
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    out = ls.search(d, i, k, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in out.collect())


def corpus(seed, n_docs, n_items):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éA", "naïve", "日本", "x_y", "A1-b2", "\u00a0q", "\x00", "½"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    passages = [text(12) for _ in range(5)]
    docs = [(i, text(40) + " " + rnd.choice(passages)) for i in range(n_docs)]
    items = [(i, rnd.choice(passages) + " " + text(9) + " " + rnd.choice(passages)) for i in range(n_items)]
    return docs, items


@pytest.mark.parametrize("entries", [ls.SHARD_ENTRIES, 40])
def test_equals_brute_force(spark, entries):
    docs, items = corpus(1, 120, 25)
    docs += [(500, None), (501, ""), (502, "?!"), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (503, "w1 " * 5000 + "w2")]
    items += [(90, None), (91, "..."), (92, "unseen"), (None, "w3 w4 W4"), (1, "w5"), (93, items[0][1])]
    assert run(spark, docs, items, entries=entries) == brute(docs, items, 10)


def test_ties_and_copies(spark):
    docs = [(i, "alpha beta") for i in range(300, 0, -1)] + [(i, "gamma") for i in range(400, 800)]
    items = [(1, "alpha"), (2, "beta alpha"), (3, "delta")]
    assert run(spark, docs, items, k=7) == brute(docs, items, 7)


def test_empty_tables(spark):
    assert not run(spark, [], [(1, "a")])
    assert not run(spark, [(1, "a")], [])
    assert not run(spark, [(1, None)], [(1, "a"), (2, None)])


def test_shared_sums(spark):
    rnd = random.Random(4)
    sets = [[f"p{i}_{j}".encode() for j in range(12)] for i in range(6)]
    bags = []
    for i in range(80):
        bag = Counter(t for s in rnd.sample(sets, 3) for t in s)
        bag.update([rnd.choice(sets[0]), f"own{i}".encode()])
        bags.append((i, dict(bag)))
    plan = ls.build_plan([*bags, (99, {})])
    leaves = np.array([[rnd.randrange(1000) for _ in range(5)] for _ in plan.terms])
    want = [[sum(n * leaves[plan.terms.index(t), d] for t, n in bag.items()) for d in range(5)] for _, bag in bags]
    assert ls.evaluate(plan, leaves).tolist() == want
    assert plan.items == list(range(80))
    # three sets of twelve and two single terms an item: most additions are shared
    assert plan.shared < plan.plain / 3


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = op11_lexical_search(spark, sf)
    want = con.execute(ORACLE["op11_lexical_search"])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.fetchall())
