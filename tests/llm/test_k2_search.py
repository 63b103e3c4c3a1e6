"""Ranked search by K2-treaps against scoring every document, and the treap against its cells."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import k2_search
from reviewlake.llm.k2_search import Treap, build_index, ranked, treap

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, mine in asked.items():
        scored = []
        for d, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def given(spark, name, *columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns)


ODD = [
    (90001, None), (90002, ""), (90003, " .,;"), (None, "that THE the thé É é 12 12"), (90004, "that " * 30000), (90005, "that the"), (90005, "that the"), (90006, "x" * 5000 + " the-that_the"),
]


def test_given_and_odd_tables(spark, monkeypatch):
    docs = given(spark, "documents", "doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    items = given(spark, "benchmark", "item_id", "text").unionByName(spark.createDataFrame([(None, "the that"), (77, None), (78, "!!"), (79, "nowherefound"), (80, "the"), (80, "that é")], "item_id long, text string"))
    want = expected([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    clash = docs.selectExpr("*", "1 AS rank", "2 AS id", "'x' AS raw", "3 AS item_id")
    assert rows(ranked(clash, items.selectExpr("*", "1 AS doc_id", "2 AS item"))) == want
    monkeypatch.setattr(k2_search, "DOCS", 23)  # many small blocks, several groups of items, whole grids, long texts in parts
    monkeypatch.setattr(k2_search, "TERMS", 300)
    monkeypatch.setattr(k2_search, "FEW", 10)
    monkeypatch.setattr(k2_search, "AT_ONCE", 50)
    monkeypatch.setattr(k2_search, "RANGES", 3)
    assert rows(ranked(docs, items)) == want


def test_empty_tables(spark):
    docs, items = given(spark, "documents", "doc_id", "text"), given(spark, "benchmark", "item_id", "text")
    assert rows(ranked(docs.limit(0), items)) == [] == rows(ranked(docs, items.limit(0)))


def test_few_best_and_ties(spark):
    docs = spark.createDataFrame([(k, "alpha beta" if k % 3 else "alpha alpha gamma") for k in range(200)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "gamma")], "item_id long, text string")
    for k in (1, 7, 50, 500):
        assert rows(ranked(docs, items, k)) == expected([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], k)


@pytest.mark.parametrize("n, height", [(1, 1), (40, 3), (700, 6), (5000, 9)])
def test_a_treap_keeps_every_cell_once(n, height):
    some = np.random.default_rng(n)
    cells = some.choice(1 << 2 * height, min(n, 1 << 2 * height), replace=False)
    rows_, cols, impacts = cells >> height, cells & ((1 << height) - 1), some.integers(1, 50, len(cells))
    t = Treap(treap(rows_, cols, impacts, height))
    assert sorted(zip(t.row, t.col, t.impact, strict=True)) == sorted(zip(rows_, cols, impacts, strict=True))
    whole = np.zeros((1 << height, 1 << height), np.int64)
    whole[rows_, cols] = impacts
    asked, weights = np.unique(some.integers(0, 1 << height, 6)), None
    weights = some.integers(1, 9, len(asked))
    scores = weights @ whole[asked]
    for k in (1, 5, 100):
        cols, got = t.best(asked, weights, k, 0, 1 << height)
        floor = max(1, np.sort(scores)[::-1][k - 1] if k < len(scores) else 1)
        assert cols.tolist() == np.flatnonzero(scores >= floor).tolist() and got.tolist() == scores[cols].tolist()


def test_the_index_holds_every_document(spark):
    docs = given(spark, "documents", "doc_id", "text")
    index, n = build_index(docs)
    held = [i for r in index.select("doc_ids").collect() for i in r[0]]
    assert sorted(held) == sorted(r[0] for r in docs.select("doc_id").collect()) and n <= len(held)


def test_sql_says_the_same(spark):
    import duckdb

    from reviewlake.llm.oracles import RANKED_SEARCH

    own = duckdb.connect()
    for name in ("documents", "benchmark"):
        own.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    got = rows(ranked(given(spark, "documents", "doc_id", "text"), given(spark, "benchmark", "item_id", "text")))
    assert got == sorted(own.sql(RANKED_SEARCH).select("item_id", "rank", "doc_id", "score").fetchall(), key=repr)
