"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from .license_scan import RESERVED, RUN, TEMPLATES, THRESHOLD

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license() -> str:
    rows = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, ts in TEMPLATES.items() for t in ts)
    norm = r"regexp_replace(regexp_replace(lower(coalesce(%s, '')), '[.!?]+[ \t]+', chr(1), 'g'), '[^\p{L}\p{N}\n\x01]+', ' ', 'g')"
    words = r"list_filter(regexp_split_to_array(%s, '[\s\x01]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    blank = r"'\n[ \n\x01]*\n'"
    return f"""
WITH templates(name, template) AS (VALUES {rows}),
t AS (SELECT name, row_number() OVER () AS tid, {words % (norm % 'template')} AS w FROM templates),
tg AS (SELECT name, tid, {grams} AS g FROM t),
d AS (SELECT doc_id, row_number() OVER () AS rn, {norm % 'text'} AS body FROM documents),
l AS (SELECT rn, unnest(string_split(body, chr(10))) AS seg FROM d),
s AS (SELECT rn, seg FROM l UNION ALL SELECT rn, unnest(string_split(seg, chr(1))) FROM l WHERE contains(seg, chr(1))
      UNION ALL SELECT rn, seg FROM (SELECT rn, unnest(regexp_split_to_array(body, {blank})) AS seg FROM d) WHERE contains(trim(seg), chr(10)) UNION ALL SELECT rn, body FROM d WHERE regexp_matches(body, {blank})
      UNION ALL SELECT rn, array_to_string(p[i : j], chr(10)) FROM (SELECT rn, p, i, unnest(range(i + 1, least(i + {RUN - 1}, len(p)) + 1)) AS j FROM (SELECT rn, p, unnest(range(1, len(p))) AS i FROM (SELECT rn, regexp_split_to_array(body, {blank}) AS p FROM d)))),
sw AS (SELECT rn, row_number() OVER () AS sid, {words % 'seg'} AS w FROM s),
sg AS (SELECT rn, sid, {grams} AS g FROM sw),
m AS (SELECT rn, sid, name, 2.0 * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) AS dice
      FROM sg JOIN tg ON len(sg.g) BETWEEN len(tg.g) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(tg.g) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
hit AS (SELECT * FROM m WHERE dice >= {THRESHOLD} - 1e-12),
best AS (SELECT rn, name, dice, row_number() OVER (PARTITION BY rn ORDER BY name = '{RESERVED}', dice DESC, name) AS r FROM hit),
cnt AS (SELECT rn, count(DISTINCT sid) AS n FROM hit GROUP BY rn)
SELECT d.doc_id, best.name AS license, round(best.dice, 6) AS dice, coalesce(cnt.n, 0) AS n_segments
FROM d LEFT JOIN best ON best.rn = d.rn AND best.r = 1 LEFT JOIN cnt ON cnt.rn = d.rn
"""


_DECON = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
ds AS (SELECT rn, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
dwin AS (SELECT rn, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM ds),
hits AS (SELECT rn, dwin.n, i, item_id FROM dwin JOIN win ON dwin.win = win.win AND dwin.n = win.n),
pos AS (SELECT DISTINCT rn, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rn, n, i FROM hits)),
cnt AS (SELECT rn, count(*) AS n_hit FROM pos GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rn, item_id FROM hits) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cnt USING (rn) LEFT JOIN its USING (rn)
"""

_NAV = "('|', '»', '›', '>', '>>', '•', '·', '/')"
_BOILER = "|".join(["all rights reserved", "cookie policy", "accept cookies", "enable javascript", "terms of service", "privacy policy", "lorem ipsum", "click here to", "sign in to", "subscribe to our newsletter", "skip to content"])

_QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
repw AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rn),
l AS (SELECT rn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
lw AS (SELECT rn, line, k, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
lj AS (SELECT *, len(array_to_string(w, '')) AS chars,
       100 * len(list_filter(w, lambda x: x IN {_NAV})) > 20 * len(w)
       OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 10 * octet_length(encode(array_to_string(w, '')))
       OR (len(w) > 60 AND NOT regexp_matches(line, '[.!?,;:…。]'))
       OR regexp_matches(lower(line), '{_BOILER}') AS bad,
       row_number() OVER (PARTITION BY rn, line ORDER BY k) AS nth
       FROM lw WHERE len(w) > 0),
ls AS (SELECT rn, sum(chars) AS chars, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, count(*) FILTER (WHERE nth > 1) AS dup, count(*) FILTER (WHERE bad) AS removed FROM lj GROUP BY rn),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(removed, 0) AS n_lines_removed
      FROM d LEFT JOIN repw USING (rn) LEFT JOIN ls USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 40 * word_chars AS kept, n_lines_removed
FROM r
"""

_SUBSTRING = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS did, row_number() OVER () AS rn, {_WORDS} AS w FROM documents),
win AS (SELECT rn, did, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT rn, did, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
low AS (SELECT s, min(did) AS low FROM win GROUP BY s HAVING min(did) < max(did)),
gone AS (SELECT rn, list_distinct(flatten(list(range(i, i + 50)))) AS spots FROM win JOIN low USING (s) WHERE low < did GROUP BY rn),
each AS (SELECT rn, i, w[i] AS word FROM (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
marks AS (SELECT rn, unnest(spots) AS i, true AS hit FROM gone),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each LEFT JOIN marks USING (rn, i) WHERE hit IS NULL GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""



def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda t: ord(t)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def _value(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN '-' ELSE octet_length(encode(CAST({text} AS VARCHAR))) || ':' || CAST({text} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_MERKLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, source, {_leaf("text")} AS leaf,
       CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM d)),
up(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
       UNION ALL SELECT tree, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3),
top(lvl, pos, n, h) AS (SELECT 0, tree, trees, h FROM up JOIN s USING (tree) WHERE n = 1
       UNION ALL SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
depth AS (SELECT tree, max(lvl) AS below FROM up GROUP BY tree),
-- a node's siblings to the left and to the right, on the levels of its own tree and then on those of the subroots
side AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
       FROM (SELECT tree, lvl, pos, n, h FROM up UNION ALL SELECT -1, lvl, pos, n, h FROM top) a
       JOIN (SELECT tree, lvl, pos, h FROM up UNION ALL SELECT -1, lvl, pos, h FROM top) b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos),
way(rn, tree, rank, lvl, pos, h, proof) AS (SELECT rn, tree, tree, 0, pos, coalesce(tampered, leaf), '' FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
       UNION ALL SELECT rn, CASE WHEN way.tree >= 0 AND side.l IS NULL THEN -1 ELSE way.tree END, rank, CASE WHEN side.l IS NULL THEN 0 ELSE way.lvl + 1 END, CASE WHEN side.l IS NULL THEN rank ELSE way.pos // 3 END,
              CASE WHEN side.l IS NULL THEN h ELSE sha256(l || h || r) END, CASE WHEN side.l IS NULL THEN proof ELSE proof || l || r END
       FROM way LEFT JOIN side ON way.tree = side.tree AND way.lvl = side.lvl AND way.pos = side.pos WHERE way.tree >= 0 OR side.l IS NOT NULL),
done AS (SELECT rn, h, proof FROM way WHERE tree = -1 QUALIFY row_number() OVER (PARTITION BY rn ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, up.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = top.h AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN up ON up.tree = s.tree AND up.n = 1 JOIN done USING (rn), top WHERE top.n = 1
"""


def _edit(cost: str, letter: str, below: str, turn: str | None = None) -> str:
    """An edit in front of what ``below`` already has: cost, audit, repaired turns."""
    turns = f"{below}.r" if turn is None else f"list_prepend({turn}, {below}.r)"
    return f"{{'c': {below}.c + {cost}, 'a': '{letter}' || {below}.a, 'r': {turns}}}"


def _repair() -> str:
    number = "coalesce(CAST({} AS VARCHAR), ' ')"
    to, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    stay = "CASE WHEN fault = 't' THEN 5 ELSE 0 END"
    ways = []
    for s in range(4):
        keep = f"CASE WHEN ini = '{role[s][0]}' THEN {_edit(stay, 'K', f'f{to[s]}', "role || ':' || text")}" + (f" WHEN ini = 's' THEN {_edit(stay, 'K', 'f1', "role || ':' || text")}" if s == 0 else "") + " END"
        both = f"[{keep}, {_edit(f'1 + {stay}', 'R', f'f{to[s]}', f"'{role[s]}:' || text")}]"
        ways.append(f"list_min(list_filter([{_edit('2', 'D', f'f{s}')}] || CASE WHEN fault IN ('b', 'd') THEN [] ELSE {both} END, lambda x: x IS NOT NULL)) AS b{s}")
    ask = lambda s, below: _edit("5", "I", below, f"'{role[s]}:'")
    return rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(number.format("conv_id") + " || ':' || " + number.format("turn"))} % 20 AS kind FROM conversations),
r1 AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
       unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM r0 JOIN ids ON r0.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE kind <> 0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS k FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY k) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen, substring(role, 1, 1) AS ini FROM r2),
r AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY c ORDER BY k) || ini AS pair FROM r3),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
       count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM r GROUP BY c),
dp(c, k, f0, f1, f2, f3) AS (
  SELECT c, n + 1, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 10::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 5::BIGINT, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} FROM counts
  UNION ALL
  SELECT c, k, list_min([b0, {ask(0, "g2")}]), list_min([b1, {ask(1, "g2")}]), g2, g3
  FROM (SELECT *, list_min([b2, {ask(2, "b3")}]) AS g2, list_min([b3, {ask(3, "b2")}]) AS g3
        FROM (SELECT r.c, r.k, {", ".join(ways)} FROM dp JOIN r ON r.c = dp.c AND r.k = dp.k - 1)))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.r, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN (SELECT c, f0 FROM dp WHERE k = 1) USING (c)
"""


ORACLE = {"op3_license_scan": _license(), "op8_quality_rules": _QUALITY, "op9_decontaminate": _DECON, "op11_substring_dedup": _SUBSTRING, "op12_conversation_repair": _repair(), "op13_merkle_manifest": _MERKLE}
