"""The same rules for one term in Python: query words are few, and need no Spark job."""

from __future__ import annotations

import re

from .text import IRREGULAR, RULES


def stem(term: str) -> str:
    if term in IRREGULAR:
        return IRREGULAR[term]
    if len(term) <= 3 or term[-1] not in "sdg" or re.search("[0-9_]", term):
        return term
    for last, pattern, cut, add in RULES:
        if term[-1] == last and re.search(pattern, term):
            return term[: len(term) - cut] + add
    return term


def normalize(token: str) -> str | None:
    """The term of a query token, None if it is no word."""
    return stem(re.sub(r"\W", "", token.lower(), flags=re.ASCII)) or None
