"""Check SQL of the similarity family, stated from the definitions: every window and every subsequence is tried.

The longest common subsequence is a bit-parallel fold over the letters of one side; the other side may have up to 126 letters.
"""

from __future__ import annotations


def common(a: str, b: str) -> str:
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum(list_transform(range(1, length({a}) + 1), "
             f"lambda i: CASE WHEN ({a})[i] = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)")
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), "
            f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})) END)")


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100::DOUBLE ELSE 200::DOUBLE * {common(a, b)} / (length({a}) + length({b})) END)"


def best_window(short: str, long: str) -> str:
    """Best ratio of the shorter string against all windows of the longer one, those cut off at its ends included."""
    windows = (f"list_distinct(list_concat(list_transform(range(1, length({long}) - length({short}) + 2), lambda i: substr({long}, i::INT, length({short})::INT)), "
               f"list_transform(range(1, length({short})), lambda k: substr({long}, 1, k::INT)), "
               f"list_transform(range(1, length({short})), lambda k: substr({long}, (length({long}) - k + 1)::INT, k::INT))))")
    return f"list_max(list_transform({windows}, lambda w: {ratio(short, 'w')}))"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\pL\\pN]', ' ', 'g'))"


def segments(x: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex({x}, '[-@|•·–—/:\\n,()\\[\\]{{}}]|\\bat\\b'), lambda s: trim(s)), lambda s: s <> '')"
    return f"list_distinct(list_append({parts}, trim({x})))"


def company(x: str) -> str:
    """Cleaned key, for names whose only tails are inc and labs."""
    flat = f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"regexp_replace({flat}, '(\\S)( (inc|labs))+$', '\\1')"


def blended(name: str, pairs: str, strict: bool = False) -> str:
    """CTEs that end in ``name(id, score)``: the best blend per id of ``pairs(id, a, b)``."""
    n = name
    guard = (f"CASE WHEN part > whole AND len(list_filter(ta, lambda t: NOT list_contains(string_split_regex(b, '\\W+'), t))) > 0 "
             f"THEN whole ELSE part END") if strict else "part"
    return f"""{n}_t AS (SELECT DISTINCT a, b, list_filter(string_split_regex(a, '\\s+'), lambda t: t <> '') AS ta,
      list_filter(string_split_regex(b, '\\s+'), lambda t: t <> '') AS tb FROM {pairs} WHERE a <> '' AND b <> ''),
  {n}_s AS (SELECT *, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb,
      array_to_string(list_sort(list_distinct(list_filter(ta, lambda t: list_contains(tb, t)))), ' ') AS shared,
      array_to_string(list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))), ' ') AS oa,
      array_to_string(list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))), ' ') AS ob,
      CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM {n}_t),
  {n}_w AS (SELECT *, trim(shared || ' ' || oa) AS wa, trim(shared || ' ' || ob) AS wb FROM {n}_s),
  {n}_r AS (SELECT *, {ratio('sa', 'sb')} AS ordered,
      CASE WHEN shared <> '' AND (oa = '' OR ob = '') THEN 100::DOUBLE WHEN shared = '' THEN {ratio('wa', 'wb')}
        ELSE greatest({ratio('wa', 'wb')}, {ratio('shared', 'wa')}, {ratio('shared', 'wb')}) END AS whole,
      CASE WHEN length(a) = length(b) THEN greatest({best_window('a', 'b')}, {best_window('b', 'a')}) ELSE {best_window('short', 'long')} END AS part
    FROM {n}_w),
  {n}_b AS (SELECT a, b, 0.5::DOUBLE * whole + 0.3::DOUBLE * ordered + 0.2::DOUBLE * ({guard}) AS score FROM {n}_r),
  {n} AS (SELECT p.id, round_even(max(coalesce(s.score, 0)), 2) AS score FROM {pairs} p LEFT JOIN {n}_b s USING (a, b) GROUP BY p.id)"""
