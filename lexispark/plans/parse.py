"""The three query languages as plain data; no Spark here.

Boolean: operands joined by AND, OR and NOT, in upper case and found anywhere, inside words
too; blanks within an operand are dropped, after NOT its last word counts. Positional:
`a /3 b /1 c`, any adjacent pair within its distance in either order. Wildcard: words of at most
two stars; the whole query is one word, or starts with a word that has no star in front
unless another form allows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.stem import normalize


@dataclass(frozen=True)
class Group:
    """Terms that a document must have, and must not have."""

    include: tuple[str, ...]
    exclude: tuple[str, ...]


def _split(pattern: str, text: str) -> list[str]:
    """re.split without the empty strings at the end."""
    out = re.split(pattern, text, flags=re.ASCII)
    while len(out) > 1 and out[-1] == "":
        out.pop()
    return out


def boolean(query: str) -> list[Group]:
    """Groups, any of which a document must meet; groups of exclusions alone are left out."""
    if not re.fullmatch(r"\s*\w[\w\s]*", query, re.ASCII):
        raise ValueError("incorrect input")
    groups = []
    for part in _split(r"\s*OR\s*", query):
        include, exclude = [], []
        for token in _split(r"\s*AND\s*", part):
            if token.startswith("NOT"):
                term = normalize(token[token.rfind(" ") + 1 :])
                if term:
                    exclude.append(term)
            else:
                include.append(normalize(token))
        if len(include) > 1 and None in include:
            raise ValueError("incorrect input")
        if include and None not in include:
            groups.append(Group(tuple(dict.fromkeys(include)), tuple(dict.fromkeys(exclude))))
    return groups


@dataclass(frozen=True)
class Positional:
    terms: tuple[str | None, ...]
    distances: tuple[int, ...]


def positional(query: str) -> Positional:
    query = query.strip(" \t\n\x0b\f\r")
    if not re.fullmatch(r"\w+(\s+/\d+\s+\w+)*", query, re.ASCII):
        raise ValueError("Wrong input format")
    parts = re.split(r"\s+", query, flags=re.ASCII)
    distances = tuple(int(x[1:]) for x in parts[1::2])
    if any(x > 2**31 - 1 for x in distances):
        raise ValueError("a distance is too large")
    return Positional(tuple(normalize(x) for x in parts[::2]), distances)


@dataclass(frozen=True)
class Word:
    """A wildcard word: star says whether it has one; else term is the plain word's term."""

    star: bool
    term: str | None = None
    prefix: str = ""
    middle: str = ""
    suffix: str = ""


_A, _B = r"\*?\w+(?:\*\w+)?", r"\w+\*?\w*(?:\w\*\w*)?"


def joker(query: str) -> list[Word]:
    """The words of a wildcard query; none if it is not of the language."""
    query = query.strip(" \t\n\x0b\f\r")
    if not re.fullmatch(rf"{_A}|{_B}(?:\s+(?:{_A}|{_B}))*", query, re.ASCII):
        return []
    out = []
    for token in re.split(r"\s+", query.lower(), flags=re.ASCII):
        if "*" not in token:
            out.append(Word(False, term=normalize(token)))
            continue
        first, last = token.index("*"), token.rindex("*")
        out.append(Word(True, prefix=token[:first], middle=token[first + 1 : last] if last > first else "", suffix=token[last + 1 :]))
    return out
