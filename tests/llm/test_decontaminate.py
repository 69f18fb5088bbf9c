"""Decontamination against a brute-force scan of all windows and items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import decontaminate as dc
from spendlake.llm.queries import op3_decontaminate


def brute(text, items, longest, overlap=0.8):
    """(item_id, question overlap, answer overlap) of the best window, every window and item tried."""
    w = dc.words(text)
    best = {}
    for start in range(0, max(1, len(w) - longest), longest):
        passage = w[start : start + 2 * longest]
        have = dc.shingles(passage)

        def share(part, passage=passage, have=have):
            p = dc.words(part)
            if not p:
                return 1.0
            if len(p) < 5:
                return float(any(passage[i : i + len(p)] == p for i in range(len(passage) - len(p) + 1)))
            return len(dc.shingles(p) & have) / len(dc.shingles(p))

        for i, q, a in items:
            got = (share(q), share(a))
            if dc.words(q) + dc.words(a) and min(got) >= overlap - 1e-9:
                best[i] = max(best.get(i, (0, 0)), got)
    return {(i, *v) for i, v in best.items()}


def longest(items):
    return max(len(dc.words(q) + dc.words(a)) for _, q, a in items)


def test_index_loses_nothing():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(1, 30))), " ".join(say(r.randrange(0, 9))) or None) for i in range(70)]
    items += [(70, "same same same same same same same", None), (71, "", ""), (72, None, None), (3, "another text of item three", "yes")]
    index = dc.Index(items, 0.8)
    found = 0
    for _ in range(300):
        body = say(r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            i = r.choice(items)
            part = dc.words(i[1]) + dc.words(i[2])
            for _ in range(r.randrange(0, 2)):
                if part:
                    part[r.randrange(len(part))] = r.choice(["x", "y"])
            at = r.randrange(len(body) + 1)
            body = body[:at] + part + body[at:]
        text = " ".join(body)
        got = {(x["item_id"], x["question_overlap"], x["answer_overlap"]) for x in index.leaks(text)}
        assert got == brute(text, items, longest(items))
        found += len(got)
    assert found > 100


def test_bound_covers_every_block():
    r = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in r.integers(0, 40, 12)), None) for i in range(100)]
    index = dc.Index(items, 0.8)
    for _ in range(50):
        terms = np.unique(r.integers(0, len(index.vocab), 25))
        slow = np.zeros(index.size)
        for t in terms:
            at = slice(index.begin[t], index.begin[t + 1])
            slow[index.post_item[at]] += index.impact[at]
        hit, score = index.retrieve(terms)
        assert hit.tolist() == np.flatnonzero(slow >= 1 - dc.EPS).tolist() and np.allclose(score, slow[hit])


def test_sentences(spark):
    rows = [(0, "One two. Three four?"), (1, "Only one."), (2, None), (3, ""), (4, "What is 2.5 plus 1? It is 3.5."), (5, "no stop")]
    got = spark.createDataFrame(rows, "item_id long, text string").select("item_id", *dc.sentences()).orderBy("item_id").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("One two. ", "Three four?"), ("Only one.", None), (None, None), ("", None), ("What is 2.5 plus 1? ", "It is 3.5."), ("no stop", None)
    ]


def test_odd_rows_and_shards(spark):
    q = "what is the name of the river that runs through the old town"
    items = spark.createDataFrame([(1, q, "the blue one"), (2, None, None), (None, "a question without any id in it", None), (4, "", "short")], "item_id long, question string, answer string")
    rows = [(0, None), (1, ""), (2, f"before. {q.upper()}! The BLUE one, after"), (3, q), (4, "a question without any id in it"), (None, f"{q} the blue one")]
    rows += [rows[2], (5, ("filler " * 50_000) + q + " the blue one"), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, leaks string")
    for size in (32 << 20, 20):
        got = dc.annotate(docs, items, shard_bytes=size)
        assert got.columns == docs.columns and got.count() == len(rows)
        flat = sorted(str((r.doc_id, r.leak.item_id)) for r in got.select("doc_id", F.explode("leaks").alias("leak")).collect())
        assert flat == sorted(map(str, [(2, 1), (2, 1), (4, None), (None, 1), (5, 1)]))
    assert dc.annotate(docs.limit(0), items).collect() == []
    assert all(r.leaks == [] for r in dc.annotate(docs, items.limit(0)).collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", *dc.sentences()).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in op3_decontaminate(spark, sf).collect()}
    n = longest(items)
    want = {(d.doc_id, *x) for d in docs for x in brute(d.text, items, n)}
    assert got == want and got
    index = {i: t for i, t in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()}
    planted = {(d.doc_id, i) for d in docs for i, t in index.items() if t in d.text}
    assert planted <= {x[:2] for x in got}
