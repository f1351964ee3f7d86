"""Keyword and pattern tests compiled from rule packs to SQL expressions.

A pack has hundreds of words and patterns. They become SQL text, parsed once per column,
because building as many Column objects one by one takes the driver seconds.

Patterns are literals, so each is compiled once per task. A pattern search is preceded by
a plain substring test for a word the pattern cannot do without, on a case-folded copy of
the text; most rows never reach the regular expression.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Ignore case, let '.' stop at '\n' only, and use Unicode word characters and spaces.
FLAGS = "(?idU)"


def literal(text: str | None) -> str:
    """A SQL string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(conditions) -> str:
    """Conditions joined by OR."""
    return "(" + " OR ".join(conditions) + ")"


def in_list(value: str, texts) -> str:
    """Membership in a list of literals."""
    return f"{value} IN ({', '.join(literal(t) for t in texts)})"


def first_value(*cases, otherwise: str | None = None) -> str:
    """Ordered (condition, value) pairs; the first true condition wins."""
    arms = " ".join(f"WHEN {condition} THEN {value}" for condition, value in cases)
    return f"(CASE {arms}{'' if otherwise is None else ' ELSE ' + otherwise} END)"


def contains_any(text: str, words) -> str:
    """True when one of the words is a substring (case-sensitive).

    A word that holds another one of the list decides nothing and is left out.
    """
    needed = [word for word in words if not any(other in word for other in words if other != word)]
    return any_of(f"contains({text}, {literal(word)})" for word in needed)


class Text(NamedTuple):
    """A text column and its case-folded copy."""

    raw: str
    folded: str


def folded(text: str) -> str:
    """Case-folded text: upper then lower joins all letters a case-blind pattern treats alike."""
    return f"lower(upper({text}))"


def required_word(pattern: str) -> str | None:
    """The longest run of letters that every match of the pattern contains."""
    bare = pattern
    while True:
        shorter = re.sub(r"\((?:[^()\\]|\\.)*\)[?*+]?", " ", bare)
        if shorter == bare:
            break
        bare = shorter
    bare = re.sub(r"\[[^\]]*\][?*+]?", " ", bare)
    bare = re.sub(r"\\.[?*+]?|\.[?*+]?", " ", bare)
    bare = re.sub(r".[?*]", " ", bare)
    runs = re.findall(r"[A-Za-z]+", bare)
    return max(runs, key=len).lower() if runs and "|" not in bare else None


def guard_words(pattern: str) -> list[str]:
    """Words of which every match of the pattern contains one; none if that is not known."""
    word = required_word(pattern)
    if word is not None:
        return [word]
    groups = [group.split("|") for group in re.findall(r"\((?:\?:)?([A-Za-z|]+)\)(?![?*])", pattern)]
    groups = [group for group in groups if min(map(len, group)) > 2]
    return [word.lower() for word in max(groups, key=lambda group: min(map(len, group)))] if groups and _flat(pattern) else []


def _flat(pattern: str) -> bool:
    """Whether no group of the pattern holds another one or looks around, and no alternative lies outside of groups."""
    groups = r"\((?:\?:)?[^()]*\)"
    return "|" not in re.sub(groups, "", pattern) and not re.search(r"[()]", re.sub(groups, "", pattern))


def searched(pattern: str) -> str:
    """The pattern with a look at its first letters in front, where it begins at a word boundary.

    A boundary is slow to test at every place of a text. What is found, and where, stays the same.
    """
    starts = re.match(r"\\b(?:([A-Za-z])(?![?*{|])|\[([A-Za-z]+)\](?![?*{])|\((?:\?:)?([A-Za-z| ]+)[(\\)\[])", pattern)
    if starts is None or "|" in re.sub(r"\(.*\)", "", pattern):
        return pattern
    one, several, group = starts.groups()
    letters = one or several or "".join(dict.fromkeys(word[:1] for word in group.split("|")))
    whole = group is None or (all(group.split("|")) and re.match(r"\\b\((?:\?:)?[A-Za-z| ]+\)(?![?*{])", pattern))
    return f"(?=[{letters}]){pattern}" if whole else pattern


def matches(text: Text, pattern: str) -> str:
    """True when the pattern occurs, ignoring case."""
    found = f"rlike({text.raw}, {literal(FLAGS + searched(pattern))})"
    words = guard_words(pattern)
    return f"({contains_any(text.folded, words)} AND {found})" if words else found


def matches_any(text: Text, patterns) -> str:
    """True when one of the patterns occurs, ignoring case."""
    return any_of(matches(text, p) for p in patterns)


def match_count(text: Text, patterns) -> str:
    """How many of the patterns occur."""
    return "(" + " + ".join(f"CAST({matches(text, p)} AS INT)" for p in patterns) + ")"
