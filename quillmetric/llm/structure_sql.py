"""SQL of the queries on page text, the Merkle manifest and conversation repair."""

# The tables' pages mark the article, and its blocks are headings and paragraphs; their texts hold five character references.
PAGE_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
blocks AS (
  SELECT page_id, url, [regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') FOR b IN
    regexp_split_to_array(body, '</?(p|h1)>')] AS marked
  FROM articles),
texts AS (
  SELECT page_id, url, array_to_string([t FOR t IN [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b,
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR b IN marked]
    IF t <> ''], chr(10)) AS text
  FROM blocks)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM texts
"""

MERKLE_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS head,
         list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]), lambda crc, c:
           list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, bit: xor(r >> 1, (r & 1) * 3988292384))) AS crc
  FROM documents),
digests AS (
  SELECT doc_id, lang, sha256(head || coalesce(concat(strlen(text), ':', text), '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(concat(strlen(text), ':', lowered), '-')) END AS changed
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM digests),
nodes AS (
  SELECT 0 AS level, lang, idx, leaf AS hash, n FROM leaves
  UNION ALL
  SELECT level + 1, lang, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1
  GROUP BY level, lang, idx // 8, n),
subs AS (
  SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, hash, n FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, idx // 8, n),
beside AS (
  SELECT false AS top, lang, level, idx,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY lang, level, idx // 8 ORDER BY idx)
  UNION ALL
  SELECT true, NULL, level, idx,
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
         coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM tops WHERE n > 1 WINDOW run AS (PARTITION BY level, idx // 8 ORDER BY idx)),
walk AS (
  SELECT doc_id, lang, leaf, idx AS leaf_idx, false AS top, 0 AS level, idx, n, coalesce(changed, leaf) AS node, '' AS passed FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.leaf_idx, w.top OR w.n = 1, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.n = 1 THEN s.idx ELSE w.idx // 8 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 7) // 8 END,
         CASE WHEN w.n = 1 THEN w.node ELSE sha256(b.before || w.node || b.after) END,
         CASE WHEN w.n = 1 THEN w.passed ELSE w.passed || b.before || b.after END
  FROM walk w JOIN subs s ON w.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN beside b ON w.n > 1 AND b.top = w.top AND b.level = w.level AND b.idx = w.idx AND (w.top OR b.lang IS NOT DISTINCT FROM w.lang)
  WHERE NOT (w.top AND w.n = 1))
SELECT w.doc_id, w.leaf, s.hash AS subroot, t.hash AS root, sha256(w.passed) AS proof_sha256, w.node AS folded_root, w.node = t.hash AS verified
FROM walk w JOIN subs s ON w.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n = 1 WHERE w.top AND w.n = 1
"""


def _cell(cost, audit, text):
    return f"{{'cost': {cost}, 'audit': {audit}, 'text': {text}}}"


def _edit(cell, more, letter, line="''"):
    return f"CASE WHEN {cell} IS NOT NULL THEN {_cell(f'{cell}.cost + {more}', f'{cell}.audit || {letter!r}', f'{cell}.text || {line}')} END"


def _least(*cells):
    return f"list_sort([c FOR c IN [{', '.join(cells)}] IF c IS NOT NULL])[1]"


_DELETED = {s: _edit(s, 2, "D") for s in "bsua"}
_KEEP = lambda cell, initial: f"CASE WHEN wanted AND initial = '{initial}' THEN {_edit(cell, 'extra', 'K', 'line')} END"
_REROLE = lambda cell, role: f"CASE WHEN wanted THEN {_edit(cell, '1 + extra', 'R', f'''{role!r} || ':' || text || chr(10)''')} END"
_INSERT = lambda cell, role: _edit(cell, 5, "I", f"'{role}:' || chr(10)")

# b, s, u, a: the cheapest {cost, audit, repaired text} of the turns so far that leaves nothing, a system, a user or an assistant turn last
REPAIR_SQL = rf"""
WITH RECURSIVE known AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fated AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(name, '')]), lambda crc, c:
    list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, bit: xor(r >> 1, (r & 1) * 3988292384)))) % 20 AS fate FROM known),
present AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM present),
judged AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed),
rows_ AS (
  SELECT *, fault IN ('none', 'truncated') AS wanted, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
         role || ':' || text || chr(10) AS line FROM judged),
cells AS (
  SELECT conv_id, 0 AS i, {_cell("CAST(0 AS BIGINT)", "''", "''")} AS b,
         CAST(NULL AS STRUCT("cost" BIGINT, audit VARCHAR, "text" VARCHAR)) AS s,
         {_cell("CAST(5 AS BIGINT)", "'I'", "'user:' || chr(10)")} AS u,
         {_cell("CAST(10 AS BIGINT)", "'II'", "'user:' || chr(10) || 'assistant:' || chr(10)")} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, b, s, u, {_least("a", _INSERT("u", "assistant"))} AS a FROM (
    SELECT conv_id, i, b, s, {_least("u", _INSERT("b", "user"), _INSERT("s", "user"), _INSERT("a", "user"))} AS u, a FROM (
      SELECT conv_id, r_i AS i, {_DELETED["b"]} AS b, {_least(_DELETED["s"], _KEEP("b", "s"))} AS s,
             {_least(_DELETED["u"], *[_KEEP(c, "u") for c in "bsa"], *[_REROLE(c, "user") for c in "bsa"])} AS u,
             {_least(_DELETED["a"], _KEEP("u", "a"), _REROLE("u", "assistant"))} AS a
      FROM (SELECT c.*, r.i AS r_i, r.wanted, r.initial, r.extra, r.line, r.text FROM cells c
            JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i + 1)))),
final AS (
  SELECT conv_id, {_least("b", "a")} AS best FROM cells QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT CAST(f.conv_id AS BIGINT) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(left(best.text, greatest(length(best.text) - 1, 0))) AS repaired_sha256
FROM final f LEFT JOIN counts c ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
