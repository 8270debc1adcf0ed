"""SQL counterparts of those queries that SQL can express."""

from __future__ import annotations

import itertools
import math
import re

from tabgauge.llm.license_texts import TEMPLATES
from tabgauge.llm.secrets import _UNIT, ALLOWED, BASE, CLASSES, WORDS_PATH, CharacterClass, _gains

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS l,
         array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
dw AS (
  SELECT doc_id, i, l, array_to_string(ws[i : i + l - 1], ' ') AS g
  FROM d, (SELECT DISTINCT l FROM iw), unnest(range(1, len(ws) - l + 2)) t(i)),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN iw USING (l, g)),
n AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _places(name: str, pattern: str, group: int) -> str:
    """CTEs with the matches of a pattern: r, s (start), v (match), part (the group)."""
    return f"""
{name}_m AS (
  SELECT r, regexp_extract_all(text, {_quoted(pattern)}, 0) AS whole,
         regexp_extract_all(text, {_quoted(pattern)}, {group}) AS parts,
         string_split_regex(text, {_quoted(pattern)}) AS pieces
  FROM t WHERE regexp_matches(text, {_quoted(pattern)})),
{name}_p AS (
  SELECT r, whole[i] AS v, parts[i] AS part,
         len(array_to_string(pieces[1 : i], '')) + len(array_to_string(whole[1 : i - 1], '')) AS s
  FROM {name}_m, unnest(range(1, len(whole) + 1)) u(i))"""


def _apart(name: str, k: int, entry: str, of: CharacterClass) -> str:
    """A CTE with what the matches of an allow-list entry leave of the candidates.

    Two entries are said in another way, without looking around and referring back: words
    are put in angle brackets, and every character is named.
    """
    value, pattern = "v", f"(?i){entry}"
    if entry == WORDS_PATH:
        value, pattern = r"regexp_replace(v, '([A-Za-z0-9]+)', '<\1>', 'g')", "<[a-z]{3,}>(?:[/_-]<[a-z]{3,}>){2,}"
    elif "\\1" in entry:
        pattern = "(?i)" + "|".join(f"{re.escape(c)}{{8,}}" for c in of.alphabet)
    length = "length(translate(array_to_string({}, ''), '<>', ''))"
    return f"""
{name}_c{k + 1} AS (
  SELECT r, s + {length.format("pieces[1 : i - 1]")} + {length.format("whole[1 : i - 1]")} AS s,
         translate(pieces[i], '<>', '') AS v
  FROM (
    SELECT r, s, string_split_regex({value}, {_quoted(pattern)}) AS pieces,
           regexp_extract_all({value}, {_quoted(pattern)}, 0) AS whole FROM {name}_c{k}),
    unnest(range(1, len(pieces) + 1)) u(i)
  WHERE length(translate(pieces[i], '<>', '')) >= {of.window})"""


def _secrets() -> str:
    ctes, base, more = [], [], []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        ctes.append(_places(kind, pattern, group))
        base.append(
            f"SELECT r, s, s + len(v) AS e, {rank} AS rank, '{kind}' AS kind FROM {kind}_p WHERE len(part) >= {least}"
        )
    for rank, of in enumerate(CLASSES, len(BASE)):
        name, w = of.kind, of.window
        value = "lower(v)" if of.kind == "entropy_hex" else "v"
        needs = " AND ".join(f"regexp_matches(v, {_quoted(n)})" for n in of.needs)
        sums = list(itertools.accumulate(_gains(w)[1:]))
        most = round((math.log2(w) - of.bits) * w * _UNIT)
        ctes.append(_places(name, of.pattern, 0))
        ctes.append(f"{name}_c0 AS (SELECT r, s, v FROM {name}_p WHERE {needs})")
        ctes += [_apart(name, k, entry, of) for k, entry in enumerate(ALLOWED)]
        ctes.append(f"""
{name}_c AS (SELECT r, s, {value} AS v FROM {name}_c{len(ALLOWED)}),
{name}_n AS (
  SELECT r, s, i, c, count(*) AS n FROM (
    SELECT r, s, i, unnest(string_split(substr(v, i + 1, {w}), '')) AS c
    FROM {name}_c, unnest(range(0, len(v) - {w} + 1)) u(i))
  GROUP BY ALL),
{name}_w AS (SELECT r, s, i FROM {name}_n GROUP BY r, s, i HAVING sum({sums}[n]) <= {most}),
{name}_g AS (
  SELECT r, s, i, sum(fresh) OVER (PARTITION BY r, s ORDER BY i) AS island FROM (
    SELECT r, s, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r, s ORDER BY i) + {w} THEN 0 ELSE 1 END AS fresh
    FROM {name}_w))""")
        more.append(
            f"SELECT r, s + min(i) AS s, s + max(i) + {w} AS e, {rank} AS rank, '{name}' AS kind"
            f" FROM {name}_g GROUP BY r, {name}_g.s, island"
        )
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    held = " FILTER (rank < 3)"
    counts = ", ".join(
        f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(BASE)
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{','.join(ctes)},
base AS ({' UNION ALL '.join(base)}),
more AS (
  SELECT * FROM ({' UNION ALL '.join(more)}) m
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s <= m.s AND b.e >= m.e)),
found AS (SELECT r, {counts}, count(*) FILTER (rank > 2) AS n_entropy, {listed}{held} AS base, {listed} AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM t LEFT JOIN found USING (r)
"""


def _components(words: int, percent: int, kept: str) -> str:
    """Documents linked by the Jaccard similarity of their shingles, from all pairs."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + {words - 1}], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - {words - 2}, 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c.n >= {percent} * (a.n + b.n - c.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
root AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id{kept}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""


def _licenses() -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in TEMPLATES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
tw AS (SELECT name, {_WORDS} AS ws FROM (VALUES {rows}) v(name, text)),
ts AS (SELECT DISTINCT name, array_to_string(ws[i : i + 2], ' ') AS g FROM tw, unnest(range(1, len(ws) - 1)) u(i)),
tm AS (SELECT name, count(*) AS m FROM ts GROUP BY name),
ds AS (SELECT r, i - 1 AS p, array_to_string(ws[i : i + 2], ' ') AS g FROM d, unnest(range(1, len(ws) - 1)) u(i)),
h AS (SELECT r, name, m, p, g FROM ds JOIN ts USING (g) JOIN tm USING (name)),
f AS (
  SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY r, name ORDER BY p) <= m // 4 + 3 THEN 0 ELSE 1 END AS fresh
  FROM h),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY r, name ORDER BY p) AS island FROM f),
matches AS (
  SELECT r, name, min(p) AS first, max(p) + 3 AS last FROM k
  GROUP BY r, name, m, island HAVING 100 * count(DISTINCT g) >= 75 * m),
s AS (
  SELECT r, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names,
         string_agg(name || ':' || first || ':' || last, ',' ORDER BY first, last, name) AS spans
  FROM matches GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)
"""


#: CTEs and an expression for the crc32 of a text's UTF-8 bytes.
_CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) u(n)))"""


def _crc32(text: str) -> str:
    byte = f"CAST('0x' || substr(hex({text}), 2 * j - 1, 2) AS BIGINT)"
    held = f"list_transform(range(1, strlen({text}) + 1), lambda j: {byte})"
    step = "lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])"
    return f"xor(4294967295, list_reduce([4294967295] || {held}, {step}))"


def _conversations() -> str:
    def more(state: str, edit: str, cost: str, line: str) -> str:
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {state}.t || chr(10) || {line})"

    def put(state: str, role: str) -> str:
        return more(state, "I", "3", f"'{role}:'")

    def turned(state: str, role: str) -> str:
        return more(state, "R", "3 + late", f"'{role}:' || text")

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN left(role, 1) = '{initial}' THEN {more(state, 'K', 'late', 'role || chr(58) || text')} ELSE none END"

    def gone(state: str) -> str:
        return f"struct_pack(c := {state}.c + 4, a := {state}.a || 'D', t := {state}.t)"

    keep = "CASE WHEN must THEN none ELSE least({}) END"
    into = {
        "s0": "none",
        "s1": keep.format(f"none, {kept('i0', 's')}"),
        "s2": keep.format(", ".join(x for q in ("i0", "i1", "i3") for x in (kept(q, "u"), turned(q, "user")))),
        "s3": keep.format(f"{kept('i2', 'a')}, {turned('i2', 'assistant')}"),
    }
    steps = ", ".join(f"least({gone('i' + s[1])}, {x}) AS {s}" for s, x in into.items())
    null = "struct_pack(c := CAST(1000000000 AS BIGINT), a := '~', t := '')"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
f AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS fate
  FROM conversations, crc),
d AS (
  SELECT k, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS p FROM d),
r AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY k, role, text ORDER BY p) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         left(lag(role) OVER (PARTITION BY k ORDER BY p), 1) || left(role, 1) AS pair
  FROM o),
m AS (SELECT k, p, role, text, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS late FROM r),
dp AS (
  SELECT k, CAST(0 AS BIGINT) AS p, struct_pack(c := CAST(0 AS BIGINT), a := '', t := '') AS s0,
         {null} AS s1, {null} AS s2, {null} AS s3 FROM f GROUP BY k
  UNION ALL
  SELECT k, p, {steps} FROM (
    SELECT k, p, role, text, must, late, none, i0, i1,
           least(j2, {put('j3', 'user')}) AS i2, least(j3, {put('j2', 'assistant')}) AS i3
    FROM (
      SELECT k, m.p, role, text, must, late, {null} AS none, s0 AS i0, s1 AS i1,
             least(s2, {put('s0', 'user')}, {put('s1', 'user')}, {put('s3', 'user')}) AS j2,
             least(s3, {put('s2', 'assistant')}) AS j3
      FROM dp JOIN m USING (k) WHERE m.p = dp.p + 1))),
w AS (SELECT k, arg_max(least(s0, s3, {put('s2', 'assistant')},
             struct_pack(c := s1.c + 6, a := s1.a || 'II', t := s1.t || chr(10) || 'user:' || chr(10) || 'assistant:')), p) AS best
  FROM dp GROUP BY k),
g AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM f) JOIN w USING (k) LEFT JOIN g USING (k)
"""


def _spelling() -> str:
    run = r"[A-Za-z\x{00C0}-\x{00FF}]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    key = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({lower}, '{run}')) AS run FROM documents)
  WHERE len(run) >= 7 GROUP BY ALL),
checked AS (SELECT run, n, {_crc32(key)} AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word
    FROM checked)
  WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, len(word) + 1)) u(i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS best FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.other END AS form,
         CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
way AS (
  SELECT word, word AS place, 0 AS steps FROM judged
  UNION ALL SELECT w.word, j.form, steps + 1 FROM way w JOIN judged j ON j.word = w.place WHERE j.form IS NOT NULL)
SELECT j.word, form, root, n, n_near, form_n
FROM judged j JOIN (SELECT word, arg_max(place, steps) AS root FROM way GROUP BY word) r ON r.word = j.word
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": _secrets(),
        "op2_licenses": _licenses(),
        "op4_near_duplicates": _components(5, 75, ", coalesce(root, doc_id) = doc_id AS kept"),
        "op5_decontamination": DECONTAMINATION,
        "op11_conversations": _conversations(),
        "op12_ngram_join": _components(4, 85, ""),
        "op13_spelling_variants": _spelling(),
    }
