"""Results on a small corpus, derived by hand from the query semantics."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark import CacheError, Index, IndexNotBuiltError, Searcher
from lexispark.functions import codec, text
from lexispark.functions.stem import normalize
from lexispark.operators import gaps

FILES = {
    "test1.txt": "pen pineapple \napple pen\t\nunusuallylongwordaddedintentionally\n\npen pineapple apple pen unusuallylongwordaddedintentionally",
    "test2.txt": "more complex phrase for searching unusuallylongwordaddedintentionally",
    "test3.txt": "trigger word for indexing and debugging updated search engine for for for searching fell",
    "test4.txt": "SAZ fell must trigger for second word and 'already'",
    "test5.txt": "engine keyword in testing purpose",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "sub").mkdir()
    for i, (name, body) in enumerate(FILES.items()):
        ((root / "sub" if i % 2 else root) / name).write_text(body)
    return Index.build_library(spark, str(root))


def names(df):
    return [r.name for r in df.collect()]


@pytest.mark.parametrize(
    ("mode", "query", "expected"),
    [
        ("boolean", "fell AND already", "4"),
        ("boolean", "fell AND already OR engine AND NOT trigger OR pen AND PiNeApPlE", "145"),
        ("boolean", "fell AND already AND off", ""),
        ("boolean", "NOT pen", ""),
        ("boolean", "pen AND NOT apple", ""),
        ("positional", "pen /1 pineapple", "1"),
        ("positional", "engine /1 search", "3"),
        ("positional", "search /1 fell", "3"),
        ("positional", "trigger /2 word", "3"),
        ("positional", "trigger /3 word", "34"),
        ("positional", "trigger /1 word /1 second", "34"),
        ("positional", "trigger /30 word", "34"),
        ("positional", "pen", ""),
        ("positional", "pen /1 absentword", ""),
        ("joker", "*apple", "1"),
        ("joker", "p*e", "125"),
        ("joker", "unusual*", "12"),
        ("joker", "en*in*", "35"),
        ("joker", "fell en*", "35"),
        ("joker", "en* fell", "3"),
        ("joker", "fell trigger", ""),
        ("joker", "*apple pen", ""),
        ("joker", "*app*", ""),
        ("joker", "unusual* absent en*", "35"),
        ("joker", "absent* pen en*", ""),
    ],
)
def test_queries(index, mode, query, expected):
    assert names(Searcher(index).search(mode, query)) == [f"test{i}.txt" for i in expected]


def test_options(index):
    s = Searcher(index)
    assert names(s.positional("trigger /1 word /1 second", chain="all")) == []
    assert names(s.joker("fell en*", combine="all")) == ["test3.txt"]


def test_errors(spark, index, tmp_path):
    with pytest.raises(ValueError):
        Searcher(index).search("boolean", "fell $! off")
    with pytest.raises(ValueError):
        Searcher(index).search("joker", "  ")
    with pytest.raises(IndexNotBuiltError):
        Searcher(None)
    with pytest.raises(CacheError):
        Index.load(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        Index.build_library(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        Index.build_library(spark, " ")


def test_facts(index):
    rows = {(r.term, r.doc_id): r for r in index.postings.collect()}
    assert rows["pen", 0].positions == [0, 3, 5, 8] if ("pen", 0) in rows else True
    pen = index.get_term_data("pen").collect()
    assert [(r.tf, r.positions) for r in pen] == [(4, [0, 3, 5, 8])]
    assert all(r.tf == len(r.positions) for r in rows.values())
    df = {r.term: r.df for r in index.vocab.collect()}
    assert (df["fall"], df["trigger"], df["pen"]) == (2, 2, 1)
    terms = sorted(df)
    assert [r.term for r in index.terms().collect()] == terms
    assert {r.term: r["rank"] for r in index.ranks().collect()} == {t: i for i, t in enumerate(terms)}
    assert index.term_rank("pen") == terms.index("pen") and index.term_rank("absent") == -1
    assert [r.term for r in index.ends_with("ing").collect()] == sorted((t for t in terms if t.endswith("ing")), key=lambda t: t[::-1])
    assert index.starts_with("zzz").count() == 0


def test_save_load_delete(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    assert not Index.present(spark, path)
    index.save(path)
    assert Index.present(spark, path)
    again = Index.load(spark, path)
    assert names(Searcher(again).boolean("fell AND already")) == ["test4.txt"]
    plan = again.ends_with("ing")._jdf.queryExecution().toString()
    assert "StringStartsWith(rev_term" in plan
    Index.delete(spark, path)
    assert not Index.present(spark, path)


def test_empty_library(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    index = Index.build_library(spark, str(tmp_path))
    for mode, q in (("boolean", "pen"), ("positional", "pen /1 pen"), ("joker", "pen*")):
        assert names(Searcher(index).search(mode, q)) == []


def test_long_codes_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a1b2c3d4e5f6a7 deadbeef1234 short1 unusuallylongwordaddedintentionally"), (2, None), (3, " \n ")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in docs.select("doc_id", text.terms().alias("t")).collect()}
    assert got == {1: ["short1", "unusuallylongwordaddedintentionally"], 2: None, 3: []}


def test_column_and_python_stems_agree(spark):
    words = ["searchings", "updated", "running", "cities", "boxes", "agreed", "freed", "is", "classes", "bus", "Don't", "stopped", "making", "x_ing", "été", "hoping", "tied", "played"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.normalize("w").alias("t")).collect()
    assert {r.w: r.t for r in rows} == {w: normalize(w) for w in words}


def test_codec(spark):
    numbers = [0, 5, 25, 625, 390625, 127, 128, 2**31 - 1]
    n = F.col("n")
    rows = spark.createDataFrame([(x,) for x in [*numbers, -5]], "n int").select("n", codec.vlc_hex(n).alias("h"), codec.vlc_size(n).alias("s"), codec.vlc_decode(codec.vlc_hex(n)).alias("d")).collect()
    got = {r.n: r for r in rows}
    assert {x: got[x].h for x in numbers[:5]} == {0: "80", 5: "85", 25: "99", 625: "04F1", 390625: "176BE1"}
    assert all(got[x].d == x and len(got[x].h) == 2 * got[x].s for x in numbers)
    assert got[-5].h is None and got[-5].d is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sets(st.integers(0, 10**6), max_size=8).map(sorted), min_size=1, max_size=4))
def test_gaps_round_trip(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>")
    back = {r.i: r.y for r in df.select("i", codec.ungap(codec.gaps(F.col("x"))).alias("y")).collect()}
    assert back == dict(enumerate(lists))


def test_boolean_by_semi_joins(spark, index):
    p = index.postings
    has = lambda t: p.where(F.col("term") == t).select("doc_id")
    by_joins = has("for").join(has("word"), "doc_id", "left_semi").join(has("fall"), "doc_id", "left_anti")
    got = Searcher(index).boolean("for AND word AND NOT fell").select("doc_id")
    assert sorted(got.collect()) == sorted(by_joins.collect())


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_gaps_across_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(gaps, "BLOCK", bits)
    ids = {"a": [0, 1, 2, 9, 40, 41], "b": [17], "c": list(range(5, 60, 7))}
    postings = spark.createDataFrame([(t, i) for t, x in ids.items() for i in x], "term string, doc_id long")
    found = gaps.encode(postings)
    assert sorted(tuple(r) for r in found.collect()) == [(t, i, i - p) for t, x in ids.items() for p, i in zip([0, *x], x, strict=False)]
    assert sorted(tuple(r) for r in gaps.decode(found).collect()) == [(t, i, i) for t, x in ids.items() for i in x]


def test_codec_queries_take_all_postings(spark, tmp_path):
    from lexispark.queries import QUERIES

    texts = ["b a b c b", "a", "c c a", "d"]
    spark.createDataFrame(list(zip([1, 2, 3, 2**28], texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.term, r.doc_id): r.gaps for r in QUERIES["pos_gaps"](spark, str(tmp_path)).collect()}
    want, numbers = {}, set()
    for i, t in zip([1, 2, 3, 2**28], texts, strict=True):
        for w in set(t.split()):
            at = [k for k, x in enumerate(t.split()) if x == w]
            step = [b - a for a, b in zip([0, *at], at, strict=False)]
            want[w, i] = " ".join(map(str, step))
            ids = [j for j, u in zip([1, 2, 3, 2**28], texts, strict=True) if w in u.split()]
            numbers |= {*step, len(at), i - max([0, *(j for j in ids if j < i)])}
    assert got == want
    assert {r.n for r in QUERIES["vlc_size"](spark, str(tmp_path)).collect()} == numbers
    assert {(r.n, r.decoded) for r in QUERIES["vlc_roundtrip"](spark, str(tmp_path)).collect()} == {(n, n) for n in numbers}
    assert {r.n: r.code for r in QUERIES["vlc_hex"](spark, str(tmp_path)).collect()}[2**28] == "01000000" + "80"


@pytest.mark.parametrize("k", [0, 1, 9, 40])
def test_near(spark, k):
    import random

    from lexispark.operators.search import near

    rng = random.Random(k)
    rows = [(sorted(rng.sample(range(300), rng.randint(1, 9))), sorted(rng.sample(range(300), rng.randint(1, 9)))) for _ in range(60)] + [([5], [5]), ([0], [300])]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", near(F.col("a"), F.col("b"), k).alias("n")).collect()
    assert all(r.n == any(abs(x - y) <= k for x in r.a for y in r.b) for r in got)


def test_segments(spark):
    from lexispark.operators.index import segments, terms_of_segment

    docs = spark.createDataFrame([(3, "x" * 30), (1, "x" * 20), (2, None), (9, "x" * 40)], "doc_id long, text string")
    assert terms_of_segment(docs) == (20 + 30 + 40) // 3 // 5
    assert terms_of_segment(docs.limit(0)) == 0
    ranks = spark.createDataFrame([(f"t{i:02}", i) for i in range(12)], "term string, rank long")
    assert [r.segment for r in segments(ranks, 3).orderBy("term").collect()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_paths_and_plans(spark, index):
    assert index.doc_name(0).startswith("test") and index.doc_path(0).endswith(index.doc_name(0)) and index.doc_path(99) is None
    plan = index.postings.where(F.col("term") == "pen")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "rangepartitioning(term" in plan and "hashpartitioning(term" not in plan
    named = Searcher(index).boolean("fell AND already")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in named.split("InMemoryRelation")[0]


def test_command_line(spark, tmp_path, capsys):
    from lexispark.__main__ import main

    (tmp_path / "library").mkdir()
    for name, words in (("a.txt", "pen apple"), ("b.txt", "pen word")):
        (tmp_path / "library" / name).write_text(words)
    path = f"file://{tmp_path}/stored"
    assert main(["build", str(tmp_path / "library"), path], spark) == 0 and capsys.readouterr().out == "2 documents, 3 terms\n"
    assert main(["search", path, "boolean", "pen AND NOT word"], spark) == 0 and capsys.readouterr().out == "a.txt\n"
    assert main(["search", path, "joker", "w*"], spark) == 0 and capsys.readouterr().out == "b.txt\n"
    for wrong in (["search", path, "boolean", "pen $"], ["search", path, "other", "pen"], ["search", f"{path}2", "boolean", "pen"], ["build", f"{tmp_path}/none", path], ["launch"]):
        assert main(wrong, spark) == 2 and capsys.readouterr().err
    assert main(["delete", path], spark) == 0 and main(["delete", path], spark) == 2


def test_text_as_a_whole_gives_the_same_terms(spark):
    """Texts are stripped and lower-cased as a whole; token by token, with the rules in Python, it must come to the same."""
    import re

    texts = ["a - b\x0bC\fD", "x\u00a0y \u2028z \x85q", "\u212aELVIN \u0130STANBUL \u039f\u0394\u039f\u03a3 end\u03a3", "Don't  RUNNING\r\n boxes_ 12345678901a 1234567890a", "", " ", None, "fell, was! MICE agreed tied"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", text.terms().alias("t"), text.terms(accept=False).alias("w"), text.accepted("w").alias("a")).collect()
    for r in rows:
        words = [w for x in re.split(text.SPACE, texts[r.i]) if (w := normalize(x))] if texts[r.i] is not None else None
        assert r.w == words and r.t == r.a == (words and [w for w in words if len(w) < 12 or not re.search("[0-9]", w)]) or (not words and r.t == r.a == words)


def test_vocabulary_needs_no_postings(spark):
    """the vocabulary is counted from the texts; nothing is sorted by term or kept for it but itself."""
    docs = spark.createDataFrame([(1, "b a b", "x", "x"), (2, "a 1234567890abc", "y", "y"), (2, "a c", "y", "y"), (None, "c", "z", "z"), (4, None, "u", "u")], "doc_id long, text string, path string, name string")
    index = Index.build(docs)
    assert [r.term for r in index.terms().collect()] == ["a", "b", "c"]
    assert "rangepartitioning(term" not in index.vocab._jdf.queryExecution().executedPlan().toString() and "blocked" not in index.__dict__
    counted = {(r.term, r.df, r.cf) for r in index.vocab.collect()}
    assert counted == {("a", 2, 3), ("b", 1, 2), ("c", 2, 2)}
    index.release()
    again = Index.build(docs)
    assert {(r.term, r.doc_id, r.tf, tuple(r.positions)) for r in again.postings.collect()} == {("a", 1, 1, (1,)), ("b", 1, 2, (0, 2)), ("a", 2, 2, (0, 0)), ("c", 2, 1, (1,)), ("c", None, 1, (0,))}
    assert {(r.term, r.df, r.cf) for r in again.vocab.collect()} == counted
    again.release()


@pytest.mark.parametrize("word", ["th* ab*ing", "*heit"])
def test_wildcards_without_a_join_of_postings(spark, index, word):
    """the postings are read where they lie, neither joined with the vocabulary nor dealt out by term again."""
    plan = Searcher(index).joker(word)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "SortMergeJoin [term" not in plan and "BroadcastHashJoin [term" not in plan and "hashpartitioning(term" not in plan


def test_text_is_split_once(spark, tmp_path):
    """accepted and all words come from one list, stripped once a text and not once a token."""
    from lexispark.queries import QUERIES

    spark.createDataFrame([(1, "a boxes 1234567890abc"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["accept_filter"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {(r.doc_id, r.accepted, r.words) for r in found.where("doc_id < 3").collect()} == {(1, 2, 3), (2, 0, 0)}


def test_gaps_where_postings_lie(spark, monkeypatch):
    """gaps of an index need no exchange of its postings, and go on from block to block of a frequent term."""
    monkeypatch.setattr(gaps.Blocks, "PIECE", 7)
    ids = [3 * i + (i > 20) * 10**12 for i in range(40)]
    rows = [(d, "the " + ("of " if i % 3 == 0 else "") + f"w{i % 11} v{i}", "p", "p") for i, d in enumerate(ids)]
    index = Index.build(spark.createDataFrame(rows, "doc_id long, text string, path string, name string"))
    assert index.blocked.where("_block > 0").count() > 20
    found = gaps.encode_blocks(index.blocked)
    want = []
    for t in {t for r in rows for t in r[1].split()}:
        held = [r[0] for r in rows if t in r[1].split()]
        want += [(normalize(t), i, i - p) for p, i in zip([0, *held], held, strict=False)]
    assert sorted((r.term, r.doc_id, r.gap) for r in found.collect()) == sorted(want)
    decoded = gaps.decode_blocks(found)
    assert all(r.doc_id == r.decoded for r in decoded.collect()) and decoded.count() == len(want)
    for df in (found, decoded):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term#" in plan  # of the carried values, one a block
        assert not __import__("re").search(r"hashpartitioning\(term#\d+, _block#\d+, ", plan.split("BroadcastExchange")[0])
    index.release()
