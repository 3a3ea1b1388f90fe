"""Fragments of the SQL checks that several queries share."""

from __future__ import annotations

SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACE}+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(expr: str) -> str:
    return f"list_filter(string_split({collapse(expr)}, ' '), lambda w: w <> '')"


def normal(expr: str) -> str:
    return collapse(f"lower({expr})")


def answer(expr: str) -> str:
    # RE2 word boundaries are ASCII only, so every non-word character is followed by a mark that stands
    # for the boundary behind it.
    bare = f"regexp_replace(lower({expr}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    marked = f"regexp_replace({bare}, '([^\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1' || chr(1), 'g')"
    cut = f"regexp_replace({marked}, '(^|\\x01)(a|an|the)([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)', '\\1 \\3', 'g')"
    return collapse(f"replace({cut}, chr(1), '')")


def shuffled(salt: str, ident: str, seed: int = 42) -> str:
    return f"md5('{seed}|{salt}|' || {ident})"


def unit(salt: str, ident: str, seed: int = 42) -> str:
    return f"(('0x' || substr({shuffled(salt, ident, seed)}, 1, 12))::bigint::double / 281474976710656.0)"
