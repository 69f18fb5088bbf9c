"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from spendlake.llm import spelling
from spendlake.llm.queries import op12_spelling


def brute_words(docs, every=31, min_chars=7, min_count=2):
    out = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def around(word, alphabet):
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1 :]
        for c in alphabet:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]


def brute(words, ratio=10):
    alphabet = sorted(set("".join(words)))
    rows = {}
    for w, n in words.items():
        close = {x for x in around(w, alphabet) if x in words and x != w and near(w, x)}
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= ratio * n else None
        rows[w] = (form, n, len(close), words[form] if form else None)
    out = []
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, k, m))
    return sorted(out, key=str)


def check(spark, words, **more):
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x")], "word string, n long, near string")
    got = spelling.variants(df, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(words)


def invented(seed, count, alphabet, least=7, most=12):
    rnd = random.Random(seed)
    roots = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(least, most))) for _ in range(count // 8)]
    words = {}
    while len(words) < count:
        w = rnd.choice(roots)
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(list(around(w, alphabet)))
        if len(w) >= least:
            words[w] = rnd.choice([2, 3, 20, 30, 500, 5000, 70000])
    return words


@pytest.mark.parametrize("block_chars", [spelling.BLOCK_CHARS, 700])
def test_equals_brute_force(spark, block_chars):
    check(spark, invented(1, 900, "abcdeéÿ×"), block_chars=block_chars)


def test_few_letters_and_one_prefix(spark):
    # words of two letters have very many neighbours; one beginning is common to all and crosses all blocks
    check(spark, invented(2, 400, "ab", 7, 9), block_chars=300)
    check(spark, {"samefirsthalf" + w: n for w, n in invented(3, 300, "xyz").items()}, block_chars=500)


def test_long_words_ties_and_chains(spark):
    long = "ab" * 3000
    words = {long: 2, long + "a": 50, "b" + long: 50, "a" * 5000: 9, "a" * 4999: 900}
    words |= {"chainaa": 2, "chainab": 20, "chainbb": 200, "chaincb": 2000, "chainbc": 200, "lonely" + "z" * 4: 7}
    check(spark, words)


def test_empty_vocabulary(spark):
    check(spark, {})
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "12 ?")], "doc_id long, text string")
    assert spelling.vocabulary(docs).collect() == []


def test_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rnd = random.Random(5)
    base = ["ÀLAÇARTE", "Wonderful", "wonderful", "streßfrei", "naïveté", "x×y÷zabc", "sixsix", "sevenun", "eightlet", "über" * 400]
    docs = [(i if i % 9 else None, " ".join(rnd.choice(base) for _ in range(rnd.randrange(30))) + ("1_" if i % 2 else "Ā日")) for i in range(200)]
    docs += [docs[3], docs[3], (7, None), (8, "")]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    for every in (0, 3):
        assert {r.word: r.n for r in spelling.vocabulary(df, every=every).collect()} == brute_words(docs, every)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = op12_spelling(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(brute_words(docs))
