"""BPE and token counts against the public libraries."""

import hashlib
import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spendlake.llm import bpe, token_counts
from spendlake.llm.queries import op1_bpe, op6_token_counts
from spendlake.session import stable_path

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t ", "a", "Hello World's  it'S we'RE 12,345 !!!", "aaaaaaa " * 40, "x" * 5000, "ab" * 3000,
    "ΑΣ ΣΑΣ Σ", "İstanbul I", "éà ́x", "a\x1cb\x1db\x1eb\x1fb\x85c d e​f　g᠎",
    "<|startoftext|>a<|endoftext|> b <|endoftext|><|endoftext|>", "<|startoftext|", "日本語 テキスト ½ Ⅷ ④ 🙂👍🏽", "it's'll'd 'S 'ſ",
    "\x00\x01\x7f", "ﬁ ① Å Å", "A\nB\r\nC\x0bD\x0cE", "!" * 999 + "…" * 50,
]


def random_texts(n=300, seed=3):
    r = random.Random(seed)
    alphabet = "abcdeétñßÄÖ'ΣσİK.,!?#*0123½ \n\t  ́̈ ​ 🙂漢字<|>" + "".join(map(chr, range(0x20, 0x7F)))
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation()
    tok.no_padding()
    texts = ODD + random_texts()
    out = bpe.decode(bpe.encode(frame(spark, texts), WORD), WORD).collect()
    assert len(out) == len(texts)
    for row in out:
        ids = tok.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids, texts[row.doc_id]
        assert row.decoded == tok.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == 7


def test_bpe_table_allows_merging_all_places_at_once():
    b = bpe.Bpe(open(WORD, "rb").read())
    assert b.at_once
    one = bpe.Bpe(open(WORD, "rb").read(), cache_size=10)
    one.at_once = False
    texts = [t or "" for t in ODD] + random_texts(100, 5)
    for t in texts:
        assert b.encode([t])[0].tolist() == one.encode([t])[0].tolist()


def test_bpe_on_an_empty_table(spark):
    assert bpe.decode(bpe.encode(frame(spark, ODD).limit(0), WORD), WORD).collect() == []


def test_op1_on_the_table(spark):
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op1_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("path", [PIECE, WORD])
def test_token_counts_equal_the_library(spark, tmp_path, path):
    texts = ODD + random_texts(60) + ODD
    docs = frame(spark, texts).unionByName(
        spark.createDataFrame([(None, "no id", "c", 1), (None, "no id", "c", 1), (0, None, "c", 1)], "doc_id long, text string, ids string, n_tokens int")
    )
    out = token_counts.count_tokens(docs, path, str(tmp_path / uuid.uuid4().hex))
    if path == PIECE:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    all_texts = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (0, None)]
    want = sorted((str(i), len((t or "").encode()), count(t or "")) for i, t in all_texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == want


def test_second_run_encodes_only_new_content(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = frame(spark, ["one", "two", "one"])
    token_counts.count_tokens(docs, PIECE, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    token_counts.count_tokens(docs.unionByName(frame(spark, ["three"])), PIECE, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    token_counts.count_tokens(docs, WORD, cache).collect()
    assert spark.read.parquet(cache).groupBy("version").count().count() == 2


def test_op6_on_the_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_op6_encodes_nothing_the_second_time(spark):
    small = SF.replace("sf0.01", "sf0.001")
    first = sorted(map(str, op6_token_counts(spark, small).collect()))
    cache = stable_path(spark, "token-cache")
    assert cache.startswith(spark.conf.get("spark.checkpoint.dir"))
    n = spark.read.parquet(cache).count()
    texts = {r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert n >= len(texts)
    assert sorted(map(str, op6_token_counts(spark, small).collect())) == first
    assert spark.read.parquet(cache).count() == n


def test_counts_of_an_empty_table(spark, tmp_path):
    assert token_counts.count_tokens(frame(spark, ODD).limit(0), PIECE, str(tmp_path / "c")).collect() == []


def test_one_pass_equals_two(spark):
    docs = frame(spark, ODD)
    two = bpe.decode(bpe.encode(docs, WORD), WORD)
    one = bpe.encode(docs, WORD, decoded_col="decoded")
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_long_texts_repeats_and_null_ids(spark):
    long = "Ünïcode words 12 and-more " * 100_000
    rows = [(None, long), (None, long), (1, "a b"), (1, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.ids), r.decoded) for r in bpe.encode(docs, WORD, decoded_col="decoded").collect())
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation()
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
