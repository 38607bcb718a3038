"""Small SQL builders for the checking statements."""

from __future__ import annotations


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(source: str, keys: str, text: str, pattern: str) -> str:
    """One row per match: keys, txt, i (from 1), hit and the zero-based start."""
    p = quoted(pattern)
    return f"""
    SELECT {keys}, txt, i, hits[i] AS hit,
      CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
        + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS INT) AS start0
    FROM (SELECT {keys}, {text} AS txt, string_split_regex({text}, {p}) AS gaps,
            regexp_extract_all({text}, {p}) AS hits FROM ({source}) AS src) AS cut,
      unnest(range(1, len(hits) + 1)) AS u(i)
    """


def excerpt(text: str, start: str, size: str, before: int, after: int) -> str:
    begin = f"greatest({start} - {before}, 0)"
    return f"substr({text}, {begin} + 1, {start} + {size} + {after} - {begin})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
