"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

SPACE = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
UNPRINTABLE = r"[^\x09\x0A\x20-\x7E\x{A0}-\x{FFFF}]"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def lines(x: str) -> str:
    return f"[l for l in [{strip('r')} for r in regexp_split_to_array({x}, '{LINE_BREAK}')] if l <> '']"


def words(x: str) -> str:
    return f"[w for w in regexp_split_to_array({x}, '{SPACE}+') if w <> '']"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def email(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '{EMAIL}'), ''), 'N/A')"


def name(x: str) -> str:
    first = f"({lines(x)})[1]"
    return f"CASE WHEN regexp_full_match({first}, '[A-Za-z .''\\-]{{2,50}}') THEN {first} ELSE 'Unknown' END"


def first_words(x: str, limit: int) -> str:
    return (
        f"CASE WHEN len({words(x)}) > {limit} "
        f"THEN array_to_string(({words(x)})[1:{limit}], ' ') ELSE {x} END"
    )


def term_counts(ids: str, source: str, stop_words: Sequence[str]) -> str:
    stop = f"WHERE term NOT IN ({listed(stop_words)})" if stop_words else ""
    return (
        f"SELECT {ids}, term, count(*) AS tf FROM "
        f"(SELECT {ids}, unnest({tokens('text')}) AS term FROM {source}) {stop} GROUP BY {ids}, term"
    )


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def distance(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"
