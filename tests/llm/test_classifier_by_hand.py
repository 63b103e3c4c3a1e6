"""The quality classifier against a plain quadratic discriminant, and the rules' verdicts one by one, over statistics counted word by word."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from reviewlake.llm import decision_list, doc_stats, qda

SF = "/root/testdata/sf0.001"


def features(text):
    """The features of one text, unscaled."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, chars, n_lines = max(1, len(words)), max(1, sum(map(len, words))), max(1, len(lines))
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    run = most = 0
    for k, w in enumerate(words):
        run = run + 1 if k and w == words[k - 1] else 1
        most = max(most, run)
    of = lambda pattern: len(re.findall(pattern, text)) if words else 0
    return {
        "words": len(words), "word_length": sum(map(len, words)) / n, "words_a_line": n / n_lines,
        "dup_line_share": (len(lines) - len(set(lines))) / n_lines, "repeat_share": len(repeated) / n, "upper_share": of("[A-Z]") / chars, "digit_share": of("[0-9]") / chars, "mark_share": of(r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]""") / chars,
        "distinct_share": len(set(words)) / n, "top_share": max(Counter(words).values(), default=0) / n, "short_line_share": sum(len(re.findall("[^\x20\x09-\x0d]+", x)) < 5 for x in lines) / n_lines, "run_share": most / n,
        "symbols_a_word": of("[#*$%&|<>]") / n, "bangs_a_word": of("!") / n, "stops_a_word": sum(w[-1] in ".?!" for w in set(words)) / n,
    }


def counted(text):
    """The features of one text, on their scales."""
    scale = lambda k, v: math.asin(math.sqrt(min(1.0, v))) if k.endswith("share") else math.log1p(4 * v if k in ("symbols_a_word", "bangs_a_word", "stops_a_word") else v)
    return {k: scale(k, v) for k, v in features(text).items()}


def by_hand(docs, labels, shrink=0.2, ridge=0.02, heat=3.0):
    names = sorted(qda.transformed())
    x = {i: np.array([counted(t)[k] for k in names]) for i, t in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = {k: np.array([x[i] for i, q in labels if q == k and not held(i) and i in x]) for k in (0, 1)}
    total = sum(map(len, rows.values()))
    own = {k: np.cov(r.T, bias=True) for k, r in rows.items()}
    pooled = sum(len(r) * own[k] for k, r in rows.items()) / total
    p = len(names)

    def density(k, v):
        a = shrink + (1 - shrink) * p / (p + len(rows[k]))
        s = (1 - ridge) * ((1 - a) * own[k] + a * pooled) + ridge * np.trace(pooled) / p * np.eye(p)
        d = v - rows[k].mean(0)
        return math.log((len(rows[k]) + 1) / (total + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d)

    return {i: (held(i), 1 / (1 + math.exp(-max(-500.0, min(500.0, (density(1, v) - density(0, v)) / heat))))) for i, v in x.items()}


def test_scores_by_hand(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "é日本! #1\n\n \nA a a a.")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    want = by_hand([tuple(r) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = qda.quality_scores(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        held, score = want[r["doc_id"]]
        assert r["held_out"] == held and abs(r["score"] - score) < 1e-6, r
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_verdicts_of_rules_by_hand(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = decision_list.learn(doc_stats.with_stats(docs), labels).rules
    got = {r["doc_id"]: r["kept"] for r in decision_list.apply_rules(docs, labels).collect()}
    assert rules and set(got.values()) == {True, False}
    for i, text in docs.collect():
        f = features(text)
        failed = f["words"] < 50 or f["repeat_share"] > 0.5
        said = next((r.label for r in rules if all(f[k] <= t if op == "<=" else f[k] >= t for k, op, t in r.conditions)), 1)
        assert got[i] == (not failed and said == 1), (i, f)
