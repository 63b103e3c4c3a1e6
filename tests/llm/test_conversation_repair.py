"""Conversation repair against a brute force over all edits, and on odd conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from reviewlake.llm.conversation_repair import damage, repair, repair_damaged

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, None, "user", "a."), (1, 3, "assistant", None), (1, 3, None, "x!"), (1, 9, "user", "Same."), (1, 12, "user", "Same."), (2, None, None, None), (None, 1, "user", "q?"), (None, 2, "assistant", "a."),
    (3, 5, "", "."), (4, 1, "system", "s."), (5, 1, "assistant", "\t \n"), (6, 2**60 + 1, "user", "end"), (6, 2**60 + 3, "assistant", "日本。"), (7, 1, "user", "u."), (7, 1, "user", "u."), (7, 1, "user", "u."),
]


def space(v):
    return " " if v is None else str(v)


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        mine = out.setdefault(c, [])
        k = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
    return out


def expected(c, mine):
    faults, seen = [], set()
    for _, role, text in mine:
        inside = [x for x in text if x not in "\x20\x09\x0a\x0b\x0c\x0d"]
        faults.append("blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(k, prev, added):
        """(cost, audit, messages) from row k on, after a message of initial prev."""
        found = [(0, "", ())] if k == len(mine) and prev in ("", "a") else []
        ok = lambda i: (prev, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
        steps = []
        if k < len(mine):
            _, role, text = mine[k]
            steps.append((2, "D", None, k + 1))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] == "truncated" else 0
                steps += [(more, "K", (role, text), k + 1), *((1 + more, "R", (r, text), k + 1) for r in ("user", "assistant"))]
        if added < 3:
            steps += [(5, "I", (r, ""), k) for r in ("user", "assistant")]
        for cost, letter, message, then in steps:
            if message is None or ok(message[0][:1]):
                rest = best(then, prev if message is None else message[0][:1], added + 1 if then == k else 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], ((message,) if message else ()) + rest[2]))
        return min(found) if found else None

    cost, audit, kept = best(0, "", 0)
    turns = [t for t, _, _ in mine if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
    whole = "\n".join(f"{r}:{t}" for r, t in kept)
    return (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def held(df, rows):
    order = lambda r: (r[0] is not None, r[0] or 0)
    got = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert sorted(got, key=order) == sorted((expected(c, m) for c, m in damaged(rows).items()), key=order)


def test_given_and_odd_conversations(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    moved = [(None if c is None else c + 10**6, *r) for c, *r in ODD]
    both = given.unionByName(spark.createDataFrame(moved, SCHEMA))
    held(repair_damaged(both), [tuple(r) for r in both.collect()])


def test_random_conversations(spark):
    some = random.Random(5)
    rows = [(c, some.choice([None, *range(12)]), some.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), some.choice(["a.", "b", "", "c!", " ", "d?", "e"])) for c in range(400) for _ in range(some.choice([1, 2, 3, 5, 9]))]
    held(repair_damaged(spark.createDataFrame(rows, SCHEMA)), rows)


def test_one_long_conversation_goes_through_many_batches(spark):
    some = random.Random(6)
    rows = [(c, t, some.choice(["user", "assistant"]), f"{some.choice('abcdefgh')}{t % 50}{some.choice(['.', '', '?'])}") for c, n in ((1, 900), (2, 3), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        got = {r["conv_id"]: r for r in repair_damaged(df).collect()}
    finally:
        spark.conf.set(name, before)
    import sys

    sys.setrecursionlimit(20000)
    want = {c: expected(c, m) for c, m in damaged(rows).items()}
    assert {c: tuple(r[k] for k in ("cost", "audit", "repaired_sha256")) for c, r in got.items()} == {c: w[6:] for c, w in want.items()}


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_damaged(none).collect() == []
    odd = spark.createDataFrame([(8, 1, "user", "Hi.", "x", 3)], SCHEMA + ", audit string, mark int")
    assert repair_damaged(odd).count() == 1
    got = repair(damage(odd)).first()
    assert (got["audit"], got["repaired"], got["cost"]) == (expected(8, damaged([(8, 1, "user", "Hi.")])[8])[7], [], 2)


def test_sql_says_the_same(spark):
    import duckdb

    from reviewlake.llm.repair_sql import CONVERSATION_REPAIR

    own = duckdb.connect()
    own.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = repair_damaged(spark.read.parquet(f"{SF}/conversations.parquet")).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(own.sql(CONVERSATION_REPAIR).select(*names).fetchall())


@pytest.mark.parametrize("rows, audit, cost", [
    ([("system", "s."), ("user", "u."), ("assistant", "a.")], "KKK", 0),
    ([("user", "u."), ("user", "v.")], "KR", 1),
    ([("user", "u."), ("assistant", "a."), ("user", "v.")], "KKD", 2),
    ([("system", "s.")], "D", 2),
    ([("user", "u"), ("assistant", "a.")], "DD", 4),
])
def test_small_repairs(spark, rows, audit, cost):
    df = spark.createDataFrame([(1, t, r, x, False) for t, (r, x) in enumerate(rows)], SCHEMA + ", dropped boolean")
    got = repair(df).first()
    assert (got["audit"], got["cost"]) == (audit, cost)


def test_token_files_go_with_the_stages(spark):
    from reviewlake.llm import common
    from reviewlake.llm.queries import tokenizer_path
    from reviewlake.llm.token_scan import open_fs, write_token_files

    since = len(common._staged)
    folder, names = write_token_files(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), tokenizer_path())
    assert names.count() == 1
    common.drop_stages(spark, since)
    system, path = open_fs(folder)
    assert system.get_file_info(path).type.name == "NotFound"
