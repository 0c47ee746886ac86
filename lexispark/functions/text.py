"""Text to terms, written once and rendered for Spark and for DuckDB.

A token is split off at white space, lower-cased, stripped of everything but [A-Za-z0-9_],
stemmed by one inflection, and accepted unless it is empty or has 12 or more characters with
a digit among them. Positions count accepted terms from 0 through the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms and their stems.
IRREGULAR = {
    "fell": "fall", "fallen": "fall", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have",
    "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go", "goes": "go", "said": "say", "made": "make", "took": "take",
    "taken": "take", "came": "come", "saw": "see", "seen": "see", "gave": "give", "given": "give", "found": "find", "got": "get",
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "people": "person",
}
_V = "[aeiouy][a-z]*"
_E = "(at|iz|iv|ov|ag|ang|rg|uc|ac|nc|rs|as|us|is|ur|ir|in)"
_DOUBLE = "(bb|dd|gg|mm|nn|pp|rr|tt)"
#: (last letter, pattern found in the term, characters cut, text appended); the first that matches holds.
RULES = [
    ("s", "(ss|us|is)$", 0, ""),
    ("s", "[^aeiou]ies$", 3, "y"),
    ("s", "(ch|sh|ss|x|zz|o)es$", 2, ""),
    ("s", "s$", 1, ""),
    ("d", "eed$", 0, ""),
    ("d", "[^aeiou]ied$", 3, "y"),
    ("d", f"{_V}{_DOUBLE}ed$", 3, ""),
    ("d", f"{_V}{_E}ed$", 1, ""),
    ("d", f"{_V}[^aeiou]ed$", 2, ""),
    ("d", f"{_V}[aeiou]ed$", 1, ""),
    ("g", f"{_V}{_DOUBLE}ing$", 4, ""),
    ("g", f"{_V}{_E}ing$", 3, "e"),
    ("g", f"{_V}[a-z]ing$", 3, ""),
]
SPACE = r"[ \t\n\x0B\f\r]+"
LONGEST_CODE = 12


def _literal(s: str, duck: bool) -> str:
    return f"'{s}'" if duck else f"r'{s}'"


def _matches(x: str, pattern: str, duck: bool) -> str:
    return f"regexp_matches({x}, {_literal(pattern, duck)})" if duck else f"{x} rlike {_literal(pattern, duck)}"


def stem_sql(x: str, duck: bool = False) -> str:
    """SQL of the stem of a normalised term; terms that end in none of the rules' letters leave first."""
    if not duck:
        return _stem_spark(x)
    whens = [f"when {x} = '{k}' then '{v}'" for k, v in IRREGULAR.items()]
    whens.append(f"when length({x}) <= 3 or right({x}, 1) not in ('s', 'd', 'g') or {_matches(x, '[0-9_]', duck)} then {x}")
    for last, pattern, cut, add in RULES:
        out = x if not cut else f"substr({x}, 1, length({x}) - {cut})"
        whens.append(f"when right({x}, 1) = '{last}' and {_matches(x, pattern, duck)} then {f'concat({out}, {add!r})' if add else out}")
    return f"case {' '.join(whens)} else {x} end"


def _stem_spark(x: str) -> str:
    """The same with few tests for most terms, as Spark interprets what it does to the members of an array: the irregular
    forms are one look-up in a set, and the rules are dealt by their last letter."""
    irregular = f"case {' '.join(f'when {x} = {k!r} then {v!r}' for k, v in IRREGULAR.items())} end"
    cases = []
    for letter in dict.fromkeys(r[0] for r in RULES):
        whens = []
        for last, pattern, cut, add in RULES:
            if last == letter:
                out = x if not cut else f"substr({x}, 1, length({x}) - {cut})"
                whens.append(f"when {_matches(x, pattern, False)} then {f'concat({out}, {add!r})' if add else out}")
        cases.append(f"when endswith({x}, '{letter}') then case when length({x}) <= 3 or {_matches(x, '[0-9_]', False)} then {x} {' '.join(whens)} else {x} end")
    return f"case when {x} in ({', '.join(map(repr, IRREGULAR))}) then {irregular} {' '.join(cases)} else {x} end"


def strip_sql(x: str, duck: bool = False) -> str:
    return f"regexp_replace(lower({x}), {_literal(chr(92) + 'W', duck)}, ''{', ' + repr('g') if duck else ''})"


def accept_sql(x: str, duck: bool = False) -> str:
    return f"{x} <> '' and (length({x}) < {LONGEST_CODE} or not {_matches(x, '[0-9]', duck)})"


def terms_sql(text: str, duck: bool = False, stem: bool = True, accept: bool = True) -> str:
    """SQL of the array of a text's terms."""
    if duck:
        out = f"list_transform(regexp_split_to_array({text}, '{SPACE}'), lambda x: {strip_sql('x', True)})"
        out = f"list_transform({out}, lambda x: {stem_sql('x', True)})" if stem else out
        return f"list_filter({out}, lambda x: {accept_sql('x', True)})" if accept else f"list_filter({out}, lambda x: x <> '')"
    # Lower-casing and stripping leave white space as it is, so a text takes one pass of each instead of one a token.
    out = f"split(regexp_replace(lower({text}), r'[^\\w{SPACE[1:-2]}]+', ''), r'{SPACE}')"
    out = f"transform({out}, x -> {stem_sql('x')})" if stem else out
    return f"filter({out}, x -> {accept_sql('x') if accept else chr(120) + ' <> ' + chr(39) * 2})"


def terms(text: str = "text", stem: bool = True, accept: bool = True) -> Column:
    return F.expr(terms_sql(text, stem=stem, accept=accept))


def accepted(terms: str) -> Column:
    """The accepted ones of an array of terms that aren't empty."""
    return F.expr(f"filter({terms}, x -> {accept_sql('x')})")


def normalize(column: str) -> Column:
    """The term of a column of tokens, null if it is no word."""
    return F.expr(f"nullif(get(transform(array({strip_sql(column)}), x -> {stem_sql('x')}), 0), '')")
