"""DuckDB SQL for the queries whose rows SQL can express: chat formatting, line dedup and secret scans.

The others need XXH64, tokenizer merges, byte windows, hundreds of overlapping expressions with places, or trained models."""

from __future__ import annotations

from . import secrets

_SAID = r"\### Assistant: </turn> ok"

OP1 = rf"""
WITH c AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
    CAST(sum(length(concat('### ', head, ': ', body, '</turn>', chr(10)))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP7 = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM s),
o AS (SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) AS ord, ltrim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) = '' AS blank FROM l),
d AS (SELECT line, min(ord) AS ord, string_split(line, ' ') AS w FROM o WHERE NOT blank GROUP BY line),
k AS (
    SELECT ord, i, md5(array_to_string(list_concat(w[1:i], w[i + 2:]), ' ')) AS rest FROM (SELECT ord, w, unnest(range(len(w))) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT ord, i, md5(array_to_string(w, ' ')) FROM (SELECT ord, w, unnest(range(len(w) + 1)) AS i FROM d WHERE len(w) >= 4)),
near AS (SELECT DISTINCT ord FROM (SELECT ord, min(ord) OVER (PARTITION BY i, rest) AS first FROM k) WHERE first < ord),
kept AS (SELECT doc_id, pos, line FROM o WHERE blank OR (ord IN (SELECT ord FROM d) AND ord NOT IN (SELECT ord FROM near))),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
    CAST(CASE WHEN x.text IS NULL THEN 0 ELSE len(string_split(x.text, chr(10))) END AS BIGINT) AS n_lines, coalesce(t.n, 0) AS n_kept
FROM documents x LEFT JOIN t ON t.doc_id = x.doc_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, ok: str, group: int = 0) -> str:
    p = _quoted(pattern)
    return (
        f"SELECT doc_id, {kind} AS kind, unnest(range(len(m))) AS i, unnest(m) AS hit, unnest(p[1:len(m)]) AS gap, unnest(g) AS value, {_quoted(ok)} AS rule FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, "
        f"string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}, {group}) AS g FROM texts) WHERE len(m) > 0"
    )


def _op8() -> str:
    # a run of exactly 40 characters between others is a whole run of those and `=`, 40 long, without `=`
    parts = [
        _matches(0, secrets.ASSIGN, "assign", 2), _matches(1, secrets.ACCESS, "all"), _matches(2, secrets.HEX, "all"), _matches(3, "[A-Za-z0-9/+=]+", "run40"), _matches(4, secrets.ENDPOINT, "all"), _matches(5, secrets.USER, "all")
    ]
    near = lambda kinds: (
        f"(coalesce(start - max(CASE WHEN kind IN ({kinds}) THEN stop END) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {secrets.SCOPE_CHARS}, false)"
        f" OR coalesce(min(CASE WHEN kind IN ({kinds}) THEN start END) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - stop <= {secrets.SCOPE_CHARS}, false))"
    )
    names = "[" + ", ".join(map(_quoted, secrets.KINDS)) + "]"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
f AS (SELECT doc_id, kind, CAST(stop AS BIGINT) - length(hit) AS start, CAST(stop AS BIGINT) AS stop FROM e
    WHERE rule = 'all' OR (rule = 'assign' AND length(value) >= {secrets.ASSIGN_LEAST}) OR (rule = 'run40' AND length(hit) = 40 AND NOT contains(hit, '='))),
n AS (SELECT *, CASE WHEN kind < 3 THEN true WHEN kind = 3 THEN {near('1')} ELSE {near('0, 1')} END AS linked FROM f),
g AS (SELECT doc_id, kind, start, concat({names}[kind + 1], ':', start, ':', stop) AS told FROM n WHERE linked),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(told, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(told, ',' ORDER BY start, kind) AS spans FROM g GROUP BY doc_id)
SELECT x.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents x LEFT JOIN a ON a.doc_id = x.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op7_line_dedup": OP7, "op8_secret_scan": _op8()}
