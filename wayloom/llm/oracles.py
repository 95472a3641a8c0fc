"""DuckDB SQL of the queries that SQL can express.

The scores of op1, op6 and op7, the CRC-32 of op8, the tree work of op9, the
packing of op10 and the eigenvectors of op11 are beyond SQL; tests hold those against brute force, round trips and held-out rows.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op2_decontamination"] = rf"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM iw, range(1, 2000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
sizes AS (SELECT DISTINCT m FROM wins),
pos AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
occ AS MATERIALIZED (SELECT p.doc_id, p.i, s.m, wins.item_id FROM pos p JOIN sizes s ON p.i + s.m - 1 <= len(p.w) JOIN wins ON wins.m = s.m AND wins.t = array_to_string(p.w[p.i:p.i + s.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN its i ON i.doc_id = d.doc_id"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
ORACLES["op3_chat_format"] = f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (SELECT *, length('<|im_start|>' || role || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10)) AS n FROM turns),
per AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM per"""

ORACLES["op4_near_duplicates"] = rf"""
WITH RECURSIVE dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sized AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS MATERIALIZED (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (SELECT x AS a, x AS b FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM dw d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.doc_id = d.doc_id"""

_LINE_RULES = rf"""
dw AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM @),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS MATERIALIZED (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '{_SPACED}')) AS n,
  regexp_replace(array_to_string(regexp_extract_all({_LOWER.format("line")}, '{_SPACED}'), ' '), '[0-9]', '0', 'g') AS k
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM dw) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT doc_id, line, count(*) AS c FROM ln GROUP BY doc_id, line) GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS d FROM (SELECT DISTINCT host, doc_id, text FROM dw) GROUP BY host),
over AS (SELECT l.host, l.k FROM (SELECT host, k, count(*) AS c FROM (SELECT DISTINCT host, k, doc_id, text FROM ln) GROUP BY host, k) l JOIN hosts h ON h.host = l.host WHERE c > 5 AND c > h.d * CAST(0.05 AS DOUBLE)),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM ln JOIN over o ON o.host = ln.host AND o.k = ln.k GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
  FROM dw d LEFT JOIN dup u ON u.doc_id = d.doc_id LEFT JOIN rep r ON r.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept FROM m"""
ORACLES["op5_line_rules"] = "WITH " + _LINE_RULES.replace("@", "documents")

ORACLES["line_rules_with_banners"] = (
    "WITH bannered AS MATERIALIZED (SELECT doc_id, source, array_to_string(list_transform(range(1, 61), lambda i: 'term' || i || '_' || source), ' ') || chr(10) || coalesce(text, '') AS text FROM documents),"
    + _LINE_RULES.replace("@", "bannered")
)


def _crc32(text: str) -> str:
    """CRC-32 of a text's bytes: each byte is taken in, then eight shifts follow."""
    steps = f"list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length({text}) + 1), lambda i: list_prepend(CAST(unicode(substr({text}, i, 1)) AS BIGINT), list_value(-1, -1, -1, -1, -1, -1, -1, -1)))))"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce({steps}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"


def _tree(first: str, group: str, depth: int) -> list[str]:
    """CTEs of the levels of a tree: {first}1, {first}2 ... from {first}0 (group, pos, h)."""
    out = []
    for i in range(depth):
        one = f"SELECT {group} AS g, pos, h, count(*) OVER (PARTITION BY {group}) AS n FROM {first}{i}" if i == 0 and group != "g" else f"SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n FROM {first}{i}"
        out.append(f"{first}{i + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM ({one}) GROUP BY g, pos // 2)")
    return out


#: Levels that the SQL unrolls: up to 4,096 documents of a language, and 16 languages.
_DEEP, _LANGS = 12, 4


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR) END"


def _merkle() -> str:
    leaf = lambda n: "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    parts = [
        f"own AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS t FROM documents)",
        "a AS MATERIALIZED (SELECT doc_id, g, leaf, coalesce(t, leaf) AS claim, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM own)",
        "l0 AS MATERIALIZED (SELECT g, pos, leaf AS h FROM a)", *_tree("l", "g", _DEEP),
        f"s0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, h, g AS grp FROM l{_DEEP})", *_tree("s", "g", _LANGS),
        f"f0 AS MATERIALIZED (SELECT doc_id, a.g, a.pos, leaf, claim AS f, '' AS proof, r.h AS subroot, s0.pos AS lang_pos, (SELECT h FROM s{_LANGS}) AS root FROM a JOIN l{_DEEP} r ON r.g = a.g JOIN s0 ON s0.grp = a.g)",
    ]
    keep = "f.doc_id, f.leaf, f.subroot, f.root"
    for i in range(_DEEP + _LANGS):
        at, level, g, pos = (f"l{i}", i, "f.g", "f.pos") if i < _DEEP else (f"s{i - _DEEP}", i - _DEEP, "0", "f.lang_pos")
        one = f"(SELECT g, count(*) AS n FROM {at} GROUP BY g)"
        fold = f"CASE WHEN c.n = 1 THEN f.f WHEN o.h IS NULL THEN sha256(f.f) WHEN ({pos} >> {level}) % 2 = 0 THEN sha256(f.f || o.h) ELSE sha256(o.h || f.f) END"
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT {keep}, f.g, f.pos, f.lang_pos, {fold} AS f, f.proof || coalesce(o.h, '') AS proof FROM f{i} f JOIN {one} c ON c.g = {g} LEFT JOIN {at} o ON o.g = {g} AND o.pos = xor({pos} >> {level}, 1))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{_DEEP + _LANGS}"


ORACLES["op12_merkle_manifest"] = _merkle()

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op13_line_dedup"] = f"""
WITH own AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ln AS MATERIALIZED (SELECT doc_id, r, i, l[i] AS line, {_LOWER.format(f"trim(l[i], {_WHITE})")} AS k FROM (SELECT doc_id, r, l, unnest(range(1, len(l) + 1)) AS i FROM own)),
shared AS MATERIALIZED (SELECT k, max(doc_id) AS top FROM ln WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
judged AS (SELECT ln.r, ln.i, ln.line, s.k IS NOT NULL AND (ln.doc_id IS NULL OR ln.doc_id < s.top) AS gone FROM ln LEFT JOIN shared s ON s.k = ln.k),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM judged GROUP BY r)
SELECT o.doc_id, k.n_lines, k.n_dropped, sha256(k.t) AS kept_sha256 FROM own o JOIN kept k ON k.r = o.r"""
