"""Similarity of strings spelled out in SQL, for the oracles."""

from __future__ import annotations


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two SQL strings: the table's rows
    are folded over the characters of a."""
    chars = f"string_split({b}, '')"
    return (f"list_last(list_reduce(string_split({a}, ''), lambda r, c: list_reduce(range(1, length({b}) + 1), lambda q, j: list_append(q, CASE WHEN {chars}[j] = c THEN r[j] + 1 ELSE greatest(r[j + 1], q[-1]) END), [0]), "
            f"list_transform(range(length({b}) + 1), lambda i: 0)))")


def token_set_sql(source: str) -> str:
    """CTE `scored` over source (id columns kept; a, b: strings) with token_set."""
    words = lambda c: f"list_distinct(list_filter(string_split(trim({c}), ' '), lambda w: w <> ''))"
    return f""", ws AS (SELECT *, {words('a')} AS wa, {words('b')} AS wb FROM {source}),
parts AS (SELECT *, list_aggregate(list_sort(list_filter(wa, lambda w: list_contains(wb, w))), 'string_agg', ' ') AS i, coalesce(list_aggregate(list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))), 'string_agg', ' '), '') AS da,
  coalesce(list_aggregate(list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))), 'string_agg', ' '), '') AS db FROM ws),
sizes AS (SELECT *, coalesce(length(i), 0) AS li, CASE WHEN length(i) > 0 THEN 1 ELSE 0 END AS gap, length(da) AS la, length(db) AS lb, CASE WHEN da = '' OR db = '' THEN 0 ELSE {lcs_sql('da', 'db')} END AS lcs FROM parts),
scored AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN li > 0 AND (la = 0 OR lb = 0) THEN 100.0
  ELSE greatest(100.0::DOUBLE * (1 - (la + lb - 2 * lcs)::DOUBLE / (2 * (li + gap) + la + lb)), CASE WHEN li > 0 THEN greatest(200.0::DOUBLE * li / (2 * li + gap + la), 200.0::DOUBLE * li / (2 * li + gap + lb)) ELSE 0 END) END AS token_set FROM sizes) """
