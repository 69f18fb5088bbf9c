"""Quality rules against a brute-force version and SQL."""

import re
from collections import Counter

import duckdb
import pytest

from spendlake.llm import quality_rules
from spendlake.llm.queries import ORACLE, op7_quality_rules


def stats(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(win)
    covered = {j for i, w in enumerate(win) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 100, "a b c " * 9 + "q r s t u v w x y z",
    "l1\nl1\n l1\n\n\nl2\nl2", "#*$%&|<>\x0b\x0cé à", " ".join(map(str, range(300))), " ".join(map(str, [*range(50), *range(20, 50), *range(7)])),
    "é ü " * 20_000,
]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words int")
    got = quality_rules.judge(docs).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        want = stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:50] if t else t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_hosts(spark):
    good = " ".join(map(str, range(40)))
    rows = [(i, good, f"good{i % 4}") for i in range(200)]
    rows += [(1000 + i, "short" if i < 45 else good, "bad") for i in range(50)]
    rows += [(2000, "short", "lone"), (2001, good, "lone"), (2002, good, None), (None, good, ""), (2002, good, None)]
    rows += [(3000 + i, "no", None) for i in range(60)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert all(kept[i] == 1 for i in range(200))
    assert not any(kept[i] for i in range(1000, 1050))
    assert kept[2001] == 1 and kept[2000] == 0 and kept[2002] == 0 and kept[None] == 1


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(ORACLE["op7_quality_rules"])
    cols = [d[0] for d in cur.description]
    got = op7_quality_rules(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(cur.fetchall())
