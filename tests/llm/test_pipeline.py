"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_decontaminate import longest
from test_line_dedup import brute as dedup
from test_ngram_join import brute as groups
from tokenizers import Tokenizer

import corpus_pipeline as cp
from spendlake.llm import decontaminate as dc
from spendlake.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 ?!", "en", "s", 6)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = [docs.select(*COLUMNS)]
    for name, stage in cp.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf), "test-" + name.replace(" ", "-")))
        if name != cp.STAGES[-1][0]:
            assert kept[-1].columns == COLUMNS
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    start, lang, lines, copies, clean, tokens = rows
    # language ID: what has no letter goes, prose stays
    assert not {r[0] for r in odd} & lang.keys()
    assert len(lang) >= 0.97 * (len(start) - len(odd)) and all(lang[d] == start[d] for d in lang)
    # line dedup
    want = {d: t for d, t, _, _ in dedup([(r.doc_id, r.text) for r in lang.values()])}
    assert {d: r.text for d, r in lines.items()} == want
    assert all(r.n_chars == len(r.text) for r in lines.values())
    # near copies: the smallest id of each group
    found = groups([(r.doc_id, r.text) for r in lines.values()], 5, 80, 100)
    first = {i for i, _, c in map(eval, found) if i == c}
    assert copies.keys() == first and all(copies[d] == lines[d] for d in copies)
    # benchmark
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", *dc.sentences()).collect()]
    n = longest(items)
    assert clean.keys() == {d for d, r in copies.items() if not leaks(r.text, items, n)}
    # tokens
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    assert tokens.keys() == clean.keys()
    for d, r in tokens.items():
        ids = tok.encode(clean[d].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert 0 < out.count() <= 200 and out.where(F.col("n_tokens") != F.size("ids")).isEmpty()


def test_stages_take_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_stages_keep_columns_of_their_own_names(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40)
    first = docs.orderBy("doc_id").first()
    more = [(None, first.text, first.lang, None), (first.doc_id, first.text, None, None), (None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for c in ("lang_found", "lang_score", "leaks_found", "n_lines", "keep", "did"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    docs = materialise(docs, "clashing")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for c in ("lang_found", "lang_score", "leaks_found", "n_lines", "keep", "did"):
            assert out.where(F.col(c) != F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))).isEmpty()
        # the text without an id stays as long as its like does, and texts that are null go or become empty
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert ids.count(first.doc_id) in (0, 1, 2) and ids.count(None) <= 2
    assert cp.tokens(spark, docs, sf).count() == docs.count()
