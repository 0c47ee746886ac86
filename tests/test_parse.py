import pytest

from lexispark.functions.stem import normalize
from lexispark.plans import parse
from lexispark.plans.parse import Group


@pytest.mark.parametrize(
    ("query", "groups"),
    [
        ("fell AND already", [Group(("fall", "already"), ())]),
        ("pen AND NOT apple OR word", [Group(("pen",), ("apple",)), Group(("word",), ())]),
        ("FORD", [Group(("f",), ()), Group(("d",), ())]),
        ("NOTEBOOK", []),
        ("pen AND NOTEBOOK", [Group(("pen",), ("notebook",))]),
        ("new york", [Group(("newyork",), ())]),
        ("pen AND NOT red apple", [Group(("pen",), ("apple",))]),
        ("NOT pen", []),
        ("PiNeApPlE", [Group(("pineapple",), ())]),
    ],
)
def test_boolean(query, groups):
    assert parse.boolean(query) == groups


@pytest.mark.parametrize("query", ["fell $! off", "", "(a)", "AND pen"])
def test_boolean_refused(query):
    with pytest.raises(ValueError):
        parse.boolean(query)


def test_positional():
    assert parse.positional("a /1 b /20 c").distances == (1, 20)
    for bad in ("a /x b", "a b", "/1 b", "a /99999999999 b"):
        with pytest.raises(ValueError):
            parse.positional(bad)


@pytest.mark.parametrize("query", ["abc", "*abc", "abc*", "ab*cd", "*ab*c", "a*bc*", "a*b*c", "fell en*"])
def test_joker_accepted(query):
    assert parse.joker(query)


@pytest.mark.parametrize("query", ["*abc*", "ab**c", "*", "*a*b*", "a*b*c*d", "*apple pen"])
def test_joker_refused(query):
    assert parse.joker(query) == []


def test_normalize():
    pairs = {"searchings": "searching", "searching": "search", "updated": "update", "running": "run", "cities": "city", "thing": "thing", "don't": "dont", "café": "caf", "!": None, "fell": "fall"}
    assert {k: normalize(k) for k in pairs} == pairs
