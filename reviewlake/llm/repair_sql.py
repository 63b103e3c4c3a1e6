"""DuckDB SQL of conversation repair: a fold over a conversation's rows that keeps the best (cost, audit, messages) of each state."""


def _step(frm: str, cost: str, letter: str, message: str | None) -> str:
    kept = f"list_append({frm}.t, {message})" if message else f"{frm}.t"
    return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {kept}}}"


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_FAR = 1 << 40
_free = "CASE WHEN x.f IN (1, 2) THEN 1099511627776 WHEN x.f = 3 THEN 5 ELSE 0 END"
_keep = lambda frm, i: _step(frm, f"(CASE WHEN x.i = '{i}' THEN {_free} ELSE {_FAR} END)", "K", "x.r || ':' || x.s")
_role = lambda frm, name: _step(frm, f"({_free} + 1)", "R", f"'{name}:' || x.s")
_more = lambda frm, name: _step(frm, "5", "I", f"'{name}:'")
_drop = lambda frm: _step(frm, "2", "D", None)

_ROW = f"""[{_drop('z[1]')}, {_best(_drop('z[2]'), _keep('z[1]', 's'))},
 {_best(_drop('z[3]'), *(w for k in (1, 2, 4) for w in (_keep(f'z[{k}]', 'u'), _role(f'z[{k}]', 'user'))))}, {_best(_drop('z[4]'), _keep('z[3]', 'a'), _role('z[3]', 'assistant'))}]"""
_USER = f"list_transform([{_ROW}], lambda v: [v[1], v[2], {_best('v[3]', *(_more(f'v[{k}]', 'user') for k in (1, 2, 4)))}, v[4]])"
_FOLD = f"list_transform({_USER}, lambda v: [v[1], v[2], v[3], {_best('v[4]', _more('v[3]', 'assistant'))}])[1]"
_START = f"[{{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {{'c': {_FAR}, 'a': '', 't': []::VARCHAR[]}}, {{'c': 5::BIGINT, 'a': 'I', 't': ['user:']}}, {{'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}}]"
_BYTE = "list_reduce(range(8), lambda y, b: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(h, g))"
_CRC = f"xor(list_reduce(list_transform(range(1, len(k) + 1), lambda p: unicode(substr(k, p, 1))::BIGINT), lambda h, g: {_BYTE}, 4294967295::BIGINT), 4294967295)"

CONVERSATION_REPAIR = rf"""WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS kind FROM o),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS r, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS s FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM h WHERE kind <> 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, s) AS p, substr(r, 1, 1) AS i, regexp_replace(s, '[\x20\x09-\x0D]+$', '') AS e FROM m),
f AS (SELECT *, CASE WHEN e = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, r, s ORDER BY p) > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM n),
g AS (SELECT conv_id, list({{'i': i, 'f': f, 'r': r, 's': s}} ORDER BY p) AS xs, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT *, list_reduce(xs, lambda z, x: {_FOLD}, {_START}) AS z FROM g), w AS (SELECT *, {_best('z[1]', 'z[4]')} AS best FROM b)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""
