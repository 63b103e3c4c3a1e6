"""Repair of conversations: the cheapest edits that make roles alternate, the least audit of all cheapest ones.

Rows are shuffled once by conversation and sorted there. A task takes whole conversations as they stream by and works on
all of them at once by array operations: a cost DP from the last row to the first over states (nothing yet, after system,
after user, after assistant), then prefix doubling over the nodes (row, state): in round k a node's rank orders the least
audits from it, cut at 2^k letters, by the pair of its own rank and that of the node 2^k letters on. Ranks pick the arc of
each node, and the path is read off doubled pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3

#: State after a message of initial 1 s, 2 u, 3 a (0 any other) in states 0 nothing, 1 after s, 2 after u, 3 after a; -1 isn't allowed.
NEXT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: The state that a user's or an assistant's message leads to, whichever may come next.
TURN = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
#: Edits in ASCII order, after the end of an audit.
LETTERS = b" DIKR"
END, DEL, INS, KEEP, ROLED, NONE = range(6)
FAR = 1 << 40

RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: each row as crc32('conv_id:turn') % 20 leaves it. Nulls are one space, also in the hashed text.

    A dropped row stays as a mark of its conversation, with no turn and text; a repeated one comes twice.
    """
    c = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    c = c.withColumns({
        "_kind": kind, "dropped": kind == 0, "role": F.when(kind == 4, "user").otherwise(F.col("role")),
        "text": F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
    })
    c = c.withColumn("_copies", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return c.select("conv_id", F.when(~F.col("dropped"), F.col("turn")).alias("turn"), "role", "text", "dropped")


def optimal_arcs(cost: np.ndarray, first: np.ndarray, size: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fill cost (a row for each node, a column for each state) and return base, step and optimal.

    Conversation c has size[c] rows from first[c] on and size[c] + 1 places from base[c] on. step[e, place, state] is the place and state,
    as one number, that edit e leads to; optimal[e, place, state] says whether the edit lies on a cheapest way to the end.
    """
    base = first + np.arange(len(first))
    last = base + size
    cost[last] = np.array([0, FAR, FAR, 0])

    def insert(at: np.ndarray | slice) -> None:
        for _ in range(2):  # a user's message, then an assistant's, or the other way round
            cost[at] = np.minimum(cost[at], cost[at][:, TURN] + INSERT)

    insert(last)
    row = np.full(len(cost), -1)  # of the table, by place
    places = np.ones(len(cost), bool)
    places[last] = False
    row[places] = np.arange(len(initial))
    bound = np.isin(fault, (BLANK, DUPLICATE))
    extra = np.where(fault == CUT_SHORT, TRUNCATED, 0)
    states = np.arange(4)

    def ways(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs and next states of Delete, Keep and Rerole for places that have a row, by state."""
        r, after = row[place], cost[place + 1]
        kept = NEXT[:, initial[r]].T
        keep = np.take_along_axis(after, np.maximum(kept, 0), 1) + extra[r, None]
        keep[(kept < 0) | bound[r, None]] = FAR
        roled = after[:, TURN] + REROLE + extra[r, None]
        roled[bound[r]] = FAR
        return np.stack([after + DELETE, keep, roled]), kept

    longest = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[longest], -np.arange(1, size.max(initial=0) + 1), "right")
    for back, n in enumerate(live.tolist(), 1):
        at = last[longest[:n]] - back
        cost[at] = np.minimum(ways(at)[0].min(0), FAR)
        insert(at)

    step = np.full((NONE, len(cost), 4), -1)
    optimal = np.zeros((NONE, len(cost), 4), bool)
    reached = cost < FAR
    at = np.flatnonzero(places)
    (dele, keep, roled), kept = ways(at)
    for edit, price, state in ((DEL, dele, np.broadcast_to(states, dele.shape)), (KEEP, keep, kept), (ROLED, roled, np.broadcast_to(TURN, roled.shape))):
        optimal[edit, at] = (price == cost[at]) & reached[at]
        step[edit, at] = (at[:, None] + 1) * 4 + state
    optimal[INS] = (cost[:, TURN] + INSERT == cost) & reached
    step[INS] = np.arange(len(cost))[:, None] * 4 + TURN
    optimal[END, last] = cost[last] == 0
    step[END, last] = last[:, None] * 4 + states
    return base, step, optimal


def ranked_pointers(step: np.ndarray, optimal: np.ndarray, letters: int) -> list[np.ndarray]:
    """Pointers of each node to the node 1, 2, 4, ... letters on along its least audit, as far as `letters` letters; ends point at themselves.

    A node has at most one optimal arc of each letter, for a state admits one next role: a rank's string leads to one node.
    """
    edits, nodes = step.shape[0], step[0].size
    step, optimal = step.reshape(edits, nodes), optimal.reshape(edits, nodes)
    own = np.arange(nodes)
    rank = np.where(optimal.any(0), optimal.argmax(0), NONE)  # edits are in the order of their letters
    there = np.where(rank < NONE, step[np.minimum(rank, NONE - 1), own], own)
    hop = there
    covered = 1
    while covered < letters:
        rank = np.unique(rank * (nodes + NONE) + rank[hop], return_inverse=True)[1]
        hop = hop[hop]
        covered *= 2
    key = np.where(optimal, np.arange(edits)[:, None] * (nodes + NONE) + rank[np.maximum(step, 0)], np.iinfo(np.int64).max)
    best = key.argmin(0)
    pointers = [np.where(optimal.any(0), step[best, own], own)]
    while 1 << len(pointers) < letters:
        pointers.append(pointers[-1][pointers[-1]])
    return [best, *pointers]


def paths(start: np.ndarray, letters: np.ndarray, pointers: list[np.ndarray]) -> list[np.ndarray]:
    """The nodes of each start's path, letters[k] + 1 of them, the end included: conversations of like length are laid out together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(start)
    bits = np.ceil(np.log2(letters + 1)).astype(int)
    for b in np.unique(bits).tolist():
        of = np.flatnonzero(bits == b)
        nodes = start[of][:, None]
        for p in pointers[:b]:
            nodes = np.hstack([nodes, p[nodes]])
        for k, line in zip(of.tolist(), nodes, strict=True):
            out[k] = line
    return out


def repaired(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each conversation of rows, which are sorted by conversation, turn, role and text. mark: BLANK, CUT_SHORT or 0."""
    ids = rows["conv_id"].to_numpy(object)
    new = np.ones(len(rows), bool)
    new[1:] = ids[1:] != ids[:-1]
    conv_of = np.cumsum(new) - 1
    names = ids[new].tolist()
    live = ~rows["dropped"].to_numpy(bool)
    size = np.bincount(conv_of[live], minlength=len(names))
    conv_of = conv_of[live]
    first = np.cumsum(size) - size
    role, text = rows["role"].to_numpy()[live], rows["text"].to_numpy()[live]

    fault = rows["mark"].to_numpy(np.int64)[live].copy()
    seen: set[tuple] = set()
    for k, key in enumerate(zip(conv_of.tolist(), role, text, strict=True)):
        if key in seen and fault[k] != BLANK:
            fault[k] = DUPLICATE
        seen.add(key)
    initial = np.array([{"s": 1, "u": 2, "a": 3}.get(r[:1], 0) for r in role], np.int64)
    count = lambda hit: np.bincount(conv_of[hit], minlength=len(names))
    together = np.zeros(len(role), bool)
    together[1:] = conv_of[1:] == conv_of[:-1]
    fine = np.zeros(len(role), bool)
    pair = initial[:-1] * 4 + initial[1:]
    fine[1:] = np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))

    timed = rows["has_turn"].to_numpy(bool)[live]
    spans = pd.DataFrame({"c": conv_of[timed], "t": rows["turn"].to_numpy()[live][timed]}).groupby("c")["t"].agg(["min", "max", "nunique"])
    gaps = np.zeros(len(names), np.int64)
    gaps[spans.index.to_numpy(np.int64)] = spans["max"] - spans["min"] + 1 - spans["nunique"]

    cost = np.full((len(role) + len(names), 4), FAR, np.int64)
    base, step, optimal = optimal_arcs(cost, first, size, initial, fault)
    letters = size + cost[base, 0] // INSERT  # no audit is longer
    best, *pointers = ranked_pointers(step, optimal, int(letters.max(initial=0)) + 1)
    audits, fixed = [], []
    for c, line in enumerate(paths(base * 4, letters, pointers)):
        edits = best[line]
        edits = edits[: int((edits == END).argmax())]
        audits.append(bytes(LETTERS[e] for e in edits.tolist()).decode())
        out = []
        for node, e in zip(line.tolist(), edits.tolist(), strict=False):
            k = node // 4 - c  # the row of the table at this place
            if e == KEEP:
                out.append({"role": role[k], "text": text[k]})
            elif e != DEL:
                out.append({"role": ROLE[int(TURN[node % 4])], "text": text[k] if e == ROLED else ""})
        fixed.append(out)
    return pd.DataFrame({
        "conv_id": names, "gaps": gaps, "blank": count(fault == BLANK), "duplicate": count(fault == DUPLICATE), "truncated": count(fault == CUT_SHORT),
        "illegal": count(together & ~fine), "cost": cost[base, 0], "audit": audits, "repaired": fixed,
    })


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired messages of every conversation.

    rows: conv_id, turn, role, text, dropped (a mark that the conversation exists, without a message). Rows of equal turns go by role,
    then text; nulls first; a null role or text is one space; a null conv_id is a conversation like others. Repeated rows are
    duplicates. A conversation without messages has zeros and an empty audit; an empty table has no rows; other columns, whatever
    their names, don't matter. A conversation is one row of the result, so its texts meet in one task, which holds no more than
    a batch and one conversation at a time.
    """
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    mark = F.when(last == "", BLANK).when(~F.right(last, F.lit(1)).isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    turn = F.col("turn").cast("long")
    r = rows.select(F.col("conv_id").cast("string").alias("conv_id"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("turn"), _text("role").alias("role"), _text("text").alias("text"), "dropped").withColumn("mark", mark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            ids = b["conv_id"].to_numpy(object)
            cut = int((ids != ids[-1]).sum())  # the last conversation may go on in the next batch
            if held:
                if cut or held[-1]["conv_id"].iloc[-1] != ids[-1]:
                    yield repaired(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
                    held = []
            elif cut:
                yield repaired(b.iloc[:cut].reset_index(drop=True))
            held.append(b.iloc[cut:])
        if held:
            yield repaired(pd.concat(held, ignore_index=True))

    sorted_rows = r.repartition("conv_id").sortWithinPartitions("conv_id", "has_turn", "turn", "role", "text")
    out = sorted_rows.mapInPandas(run, RESULT)
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of damaged conversations, with a digest of what each has become in place of its messages."""
    whole = F.array_join(F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return repair(damage(conversations)).withColumn("repaired_sha256", F.sha2(whole.cast("binary"), 256)).drop("repaired")
