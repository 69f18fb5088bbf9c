"""Line dedup against a brute-force version."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from spendlake.llm import line_dedup
from spendlake.llm.queries import ORACLE, op9_line_dedup

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(BLANKS)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= min_chars else None

    holds = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holds[key(line)].add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = -(2**63) if d is None else d
        kept = [x for x in lines if key(x) is None or len(holds[key(x)]) < min_docs or max(holds[key(x)]) == me]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, did string, n_lines int")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()))) == sorted(map(str, brute(rows)))


def test_shared_lines(spark):
    a, b, c = "a" * 40, "B" * 55 + " é", "short line"
    rows = [(i, f"{c}\n {a}\t\n{i} own line that is long enough to count as a key\n{b.lower() if i % 2 else b}\n{a.upper()}") for i in range(9)]
    rows += [(100, None), (101, ""), (102, a), (None, a), (None, b), (103, "\n\n" + a + "\n"), (3, rows[3][1]), (4, b + "\n" + c)]
    rows += [(i, "four times only, so it stays in every document") for i in range(200, 204)]
    check(spark, rows)


def test_one_line_in_most_rows_crosses_task_borders(spark):
    hot = "the same line in nearly every document of the table"
    check(spark, [(i, (hot + "\n") * (1 + i % 3) + f"line {i % 7} that seven groups of documents share with it") for i in range(800)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect() == []


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op9_line_dedup"]).fetchall())
    got = op9_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    mine = {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, g in brute([tuple(r) for r in docs])}
    assert {r.doc_id: tuple(r)[1:] for r in got} == mine
