"""Each operator against a plain version of itself, and on the odd cases its docstring defines."""

import base64
import hashlib
import html
import math
import os
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexispark.llm import decontam, htmltext, jaccard, knlm, langid, licenses, quality, shards, spans, spm, warc
from lexispark.llm.components import components
from lexispark.llm.shards import Packer, Scratch, unpack
from lexispark.llm.textblock import LOWER, TextBlock, mix, shingle_sets

SCHEMA = "doc_id long, text string, lang string, score double, _id string, _first int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, langs[k] if langs else "en", 9.9, "x", 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sentences_of(rng, n, words=400):
    vocab = [f"w{i}" for i in range(words)]
    return " ".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "a b c", "É ß 日本", "x" * 3000, "same words here again and again", "same words here again and again"]


# Words and shards


def test_words_and_hashes():
    texts = [*ODD, "tab\tand\x0bvertical\nline", "é   wide"]
    block = TextBlock(pa.array(texts, pa.string()))
    got = [[block.buf[a:b].tobytes().decode() for a, b in zip(block.start[lo:hi], block.end[lo:hi], strict=True)] for lo, hi in zip(block.words_at[:-1], block.words_at[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    by_word = defaultdict(set)
    for w, h in zip((w for ws in got for w in ws), block.word_hash().tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    sliced = TextBlock(pa.array(["junk", *texts], pa.string()).slice(1))
    assert (sliced.word_hash() == block.word_hash()).all()


def test_packer_round_trip():
    rng = np.random.default_rng(1)
    keys, values = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 1000, 5000)
    packer = Packer(7, ["<u8", "<u4"], limit=900)
    batches = [b for k in range(0, 5000, 300) for b in packer.add(keys[k : k + 300], values[k : k + 300])] + list(packer.flush())
    k, v = unpack(iter(batches), ["<u8", "<u4"])
    assert sorted(zip(k.tolist(), v.tolist(), strict=True)) == sorted(zip(keys.tolist(), values.tolist(), strict=True))


def test_more_shards_than_partitions(spark, monkeypatch):
    """Shards that share a partition are worked on one at a time, sorted by Spark."""
    monkeypatch.setattr(shards, "n_partitions", lambda spark, n: 3)
    docs = spark.range(0, 5000, 1, 5)
    n = 17

    def send(batches):
        packer = Packer(n, ["<u8", "<u4"], limit=700)
        for b in batches:
            x = b.column("id").to_numpy().astype(np.uint64)
            yield from packer.add(mix(x), x % 10)
        yield from packer.flush()

    def work(batches):
        k, v = unpack(batches, ["<u8", "<u4"])
        yield pa.RecordBatch.from_pydict({"n": [len(k)], "total": [int(v.sum())], "shards": [len(np.unique((k >> np.uint64(33)) % np.uint64(n)))]})

    rows = shards.deal(docs.mapInArrow(send, Packer.schema(2)), n, work, "n long, total long, shards long").collect()
    assert len(rows) == n and {r.shards for r in rows} == {1}
    assert (sum(r.n for r in rows), sum(r.total for r in rows)) == (5000, 5000 * 9 // 2)


def test_small_tables_are_measured(spark, monkeypatch):
    wide = spark.createDataFrame([(i, "x" * 1000, [1, 2, 3]) for i in range(100)], "a long, b string, c array<long>")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(shards.if_small(wide))
    monkeypatch.setattr(shards, "SMALL_BYTES", 50_000)
    assert "broadcast" not in plan(shards.if_small(wide)) and "broadcast" in plan(shards.if_small(wide.select("a", "c")))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for a, b in links for x in (a, b) if find(a) == find(b) and (a != b or find(a) != a or any(y in (a, b) and p != q for p, q in links for y in (p, q)))}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# 1 Language


def test_language(spark):
    rng = random.Random(2)
    vocab = {"en": "the of and to in that with for", "de": "der die und das nicht mit ein von", "fr": "le la les des et une dans pour", "es": "el los las una que por con del", "it": "il che gli della sono per non con", "sv": "och att det som en på är av"}
    texts, langs = [], []
    for lang, words in vocab.items():
        for _ in range(40):
            texts.append(" ".join(rng.choice(words.split()) for _ in range(30)))
            langs.append(lang)
    docs = frame(spark, texts + ODD, langs=langs + [None] * len(ODD))
    model = langid.train(docs, Scratch(spark))
    assert model.langs == sorted(vocab)
    code = model.code.astype(int)
    assert min((code[i] != code[j]).sum() for i in range(6) for j in range(i)) >= 6
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert sum(rows[i].lang_pred == lang for i, lang in enumerate(langs)) >= 0.98 * len(langs)
    for k, t in enumerate(ODD):
        r = rows[len(texts) + k]
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
        assert r.lang_pred != "und" or (r.score == 0 and r.ambiguous)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(r.lang_pred == "und" for r in rows.values())


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "de"]])
def test_language_few(spark, langs):
    docs = frame(spark, [f"{x} text number" for x in langs] + ["some text"], langs=[*langs, None])
    rows = langid.predict(docs, langid.train(docs, Scratch(spark))).collect()
    assert {r.lang_pred for r in rows} <= ({*langs} or {"und"})


def test_language_rows_are_sampled_not_ids(spark):
    vocab = {"en": "the of and to in that with for", "de": "der die und das nicht mit ein von"}
    rng = random.Random(3)
    say = lambda x: " ".join(rng.choice(vocab[x].split()) for _ in range(30))
    for ids in ([None] * 60, [5] * 60):
        docs = frame(spark, [say("en" if k % 2 else "de") for k in range(60)], list(ids), ["en" if k % 2 else "de" for k in range(60)])
        model = langid.train(docs, Scratch(spark), max_docs_per_lang=3)
        assert model.langs == ["de", "en"]
        assert {r.lang_pred for r in langid.predict(frame(spark, [say("en")] * 3), model).collect()} == {"en"}
    same = frame(spark, [say("en")] * 50 + ["el los las una que"], [5] * 50 + [None], ["en"] * 50 + ["es"])
    assert langid.train(same, Scratch(spark), max_docs_per_lang=3).langs == ["en", "es"]


def plain_language(train, texts):
    """The same classifiers with dictionaries: byte pairs and hashed triples, log odds a bit, loss-weighted decoding."""

    def grams(t):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in (t or "").encode()]
        out = []
        for i in range(len(b) - 2):
            if b[i + 1] != 32 or (b[i] != 32 and b[i + 2] != 32):
                three = (b[i] << 16) | (b[i + 1] << 8) | b[i + 2]
                out += [(b[i] << 8) | b[i + 1], 65536 + ((three * 0x9E3779B1 & 0xFFFFFFFF) >> 16)]
        return out

    langs = sorted({x for _, x in train})
    counts = {x: Counter() for x in langs}
    for t, x in train:
        counts[x].update(grams(t))
    code = [[1 if (c >> i) & 1 else -1 for c in range(1, 2 ** (len(langs) - 1))] for i in range(len(langs))]
    sums = {(x, s): sum(v for g, v in counts[x].items() if (g >= 65536) == s) + 65536 * 0.005 for x in langs for s in (False, True)}
    share = lambda x, g: (counts[x][g] + 0.005) / sums[x, g >= 65536]

    def odds(g, b):
        one, other = ([share(x, g) for x, c in zip(langs, code, strict=True) if c[b] == s] for s in (1, -1))
        return math.log(sum(one) / len(one)) - math.log(sum(other) / len(other))

    def margin(t):
        g = grams(t)
        return [sum(odds(x, b) for x in g) / max(len(g) // 2, 1) for b in range(len(code[0]))]

    z = [(margin(t), langs.index(x)) for t, x in train if any(c.isalpha() for c in t)]
    scale = [sum(abs(m[b]) for m, _ in z) / len(z) for b in range(len(code[0]))]
    trust = [[(sum(m[b] * c[b] > 0 for m, k in z if k == i) + 1) / (sum(k == i for _, k in z) + 2) for b in range(len(c))] for i, c in enumerate(code)]
    trust = [[x / sum(row) for x in row] for row in trust]
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        m = [max(-4, min(4, x / s)) for x, s in zip(margin(t), scale, strict=True)]
        cost = [sum(w * math.exp(-x * c) for w, x, c in zip(trust[i], m, code[i], strict=True)) for i in range(len(langs))]
        best = min(range(len(langs)), key=cost.__getitem__)
        out.append((langs[best], 1 / sum(math.exp(cost[best] - c) for c in cost)))
    return out


def test_language_against_plain_decoding(spark):
    rng = random.Random(12)
    vocab = {"en": "the of and to in that with for", "de": "der die und das nicht mit ein über", "fr": "le la les des et où dans pour"}
    train = [(" ".join(rng.choice(words.split()) for _ in range(12)), x) for x, words in vocab.items() for _ in range(8)]
    texts = [*ODD, "the der le", *(" ".join(rng.choice(" ".join(vocab.values()).split()) for _ in range(6)) for _ in range(20))]
    model = langid.train(frame(spark, [t for t, _ in train], langs=[x for _, x in train]), Scratch(spark))
    rows = {r.doc_id: r for r in langid.predict(frame(spark, texts), model).collect()}
    for i, (lang, score) in enumerate(plain_language(train, texts)):
        assert rows[i].lang_pred == lang and rows[i].score == pytest.approx(score, abs=1e-3)


# 2 Quality


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    dup = len(lines) - len(set(lines))
    sym = sum(c in "#*$%&|<>" for c in t)
    chars = sum(map(len, w))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    alpha = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", x)) for x in w)
    kept = not (failed or chars < 2 * len(w) or chars > 15 * len(w) or 10 * sym > len(w) or 10 * dup > 3 * len(lines) or 10 * alpha < 8 * len(w) or 10 * max(Counter(w).values(), default=0) > 3 * len(w))
    strip = lambda x: x.strip("\x20\t\n\x0b\x0c\r")
    kept = kept and not (10 * max(Counter(zip(w, w[1:], strict=False)).values(), default=0) > 2 * len(w) or 10 * sum(strip(x)[0] in "-*•" for x in lines) > 9 * len(lines) or 10 * sum(strip(x).endswith(("...", "…")) for x in lines) > 3 * len(lines))
    return (len(w), chars, sym, dup, len(rep), failed, kept)


def test_quality(spark):
    rng = random.Random(5)
    texts = [*ODD, *(sentences_of(rng, rng.randint(3, 30)) for _ in range(20)), sentences_of(rng, 9) + "\n" + "line of text\n" * 9, "w " * 200, "## ** " * 60, "12 34 56 78 " * 30, "a\r\nb\r\n" * 40, sentences_of(rng, 8) + " é ü \n x"]
    say = lambda mark, end: "\n".join(f"{mark}{sentences_of(rng, 1)}{end} \r" for _ in range(9))
    texts += [say("- ", ""), say("\t• ", ""), say("* ", "") + "\n" + sentences_of(rng, 4), say("", ".."), say("", "…"), " ".join(f"of the w{k}" for k in range(40)), " ".join(f"{k} {7 * k + 1000}" for k in range(60)), sentences_of(rng, 9000)]
    ids = [*range(len(texts))]
    ids[-1], ids[-2] = None, None
    docs = frame(spark, texts, ids)
    order = quality.measure_rules(docs)
    assert sorted(order) == sorted(quality.RULES)
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for o in (order, order[::-1]):
        rows = sorted(((r.doc_id, *(r[c] for c in cols)) for r in quality.cascade(docs, o).collect()), key=str)
        assert rows == sorted(((i, *plain_quality(t)) for i, t in zip(ids, texts, strict=True)), key=str)
    assert quality.cascade(docs.limit(0), quality.measure_rules(docs.limit(0))).count() == 0
    for name in ("bullets", "ellipses", "top_pair", "top_word", "alpha_words"):
        assert quality.cascade(docs, [name]).where(F.col("rejected_by") == name).count() > 0
    stopped = quality.cascade(docs, order).where("rejected_by = 'base'").collect()
    assert stopped and all(r.rules_run == 0 for r in stopped)


# 3 Language model


def plain_discounts(counts):
    """Chen and Goodman's, with half of the count where counts of counts are missing."""
    n = [sum(c == k for c in counts) for k in range(5)]
    if not n[1] or not n[2]:
        return [0, 0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] and n[k + 1] else k / 2 for k in (1, 2, 3))]


def plain_kn(train, tests, order):
    """By the definition, with no table but the counts of n-grams."""
    pad = ["<s>"] * (order - 1)
    seqs = [[*WORD.findall(lower(t)), None] for t in train]
    uni = Counter(w for s in seqs for w in s)
    total, v = sum(uni.values()), len(uni)
    counts = {order: Counter(tuple((pad + s)[i : i + order]) for s in seqs for i in range(len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {k: plain_discounts(c.values()) for k, c in counts.items()}
    followers = {k: defaultdict(list) for k in counts}
    for k, found in counts.items():
        for g, c in found.items():
            followers[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        shorter = p(g[1:]) if k > 1 else 1 / (v + 1)
        have = followers[k].get(g[:-1])
        if not have:
            return shorter
        c = counts[k][g]
        return (max(c - cut[k][min(c, 3)], 0) + sum(cut[k][min(x, 3)] for x in have) * shorter) / sum(have)

    out = []
    for t in tests:
        s = [*WORD.findall(lower(t)), None]
        score = sum(math.log10(p(tuple((pad + s)[i : i + order]))) for i in range(len(s)))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (v + 1))) for w in s)
        out.append((len(s), sum(w in uni for w in s), total, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, order):
    rng = random.Random(6)
    train = [sentences_of(rng, rng.randint(1, 8), words=60) for _ in range(40)] + [None, "", "only once"]
    tests = [*train[:5], *ODD, sentences_of(rng, 4, words=80), "w1 W1 w1 unseen w2", "w3 " * 30_000]
    model = knlm.train(frame(spark, train), Scratch(spark), order)
    found = knlm.score(frame(spark, tests), model)
    rows = {r.doc_id: r for r in found.collect()}
    for i, want in enumerate(plain_kn(train, tests, order)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)
    empty = knlm.train(frame(spark, []), Scratch(spark), order)
    assert all(r.score == 0 and r.base_score == 0 for r in knlm.score(frame(spark, ["a b", None]), empty).collect())


def test_language_model_rows(spark):
    train = frame(spark, ["a b a b c", "a b"] * 3).withColumn("score", F.lit("x")).withColumn("n_tokens", F.lit(None).cast("int"))
    model = knlm.train(train, Scratch(spark))
    assert model.train_tokens == 27
    same = train.withColumn("doc_id", F.lit(None).cast("long"))
    rows = knlm.score(same, model).collect()
    assert len(rows) == 6 and all(r.doc_id is None for r in rows) and len({r.score for r in rows}) == 2
    none = knlm.score(train.limit(0), model)
    assert none.columns[:3] == ["doc_id", "n_tokens", "n_known"] and none.count() == 0
    with pytest.raises(ValueError, match="order"):
        knlm.train(train, Scratch(spark), 1)


def test_each_length_is_looked_up_once(spark, monkeypatch):
    """n-grams and contexts of a length go together, and the longest, sorted already, aren't sorted again."""
    texts = [sentences_of(random.Random(i), 3) for i in range(6)]
    model, calls = knlm.train(frame(spark, texts), Scratch(spark)), []
    find = knlm.Grams.find
    monkeypatch.setattr(knlm.Grams, "find", lambda self, keys: calls.append(self.name) or find(self, keys))
    knlm.log_probs(TextBlock(pa.array(texts), LOWER), model)
    assert calls == ["g2_"]


def test_grams_in_buckets(tmp_path):
    rng = np.random.default_rng(5)
    for n, size in ((1, 1), (1, 5000), (3, 900)):
        keys = rng.integers(0, 2**64, size, np.uint64)
        values = [rng.integers(0, 400, size).astype(np.uint64), np.arange(size, dtype=np.uint64)]
        shards = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        for i in range(n):
            mine = shards == i
            if mine.any():
                knlm.put_grams(f"{tmp_path}/x{n}{size}_{i}", keys[mine], n, [v[mine] for v in values])
            else:
                (tmp_path / f"x{n}{size}_{i}").touch()
        grams = knlm.Grams(str(tmp_path), f"x{n}{size}_", n, 2)
        assert (grams.find(keys) == np.stack(values, axis=1)).all()
        assert not grams.find(rng.integers(0, 2**64, 1000, np.uint64)).any()


@pytest.mark.parametrize("bits", [7, 20, 33, 64])
def test_grams_are_added_up(bits):
    rng = random.Random(bits)
    grams = [tuple(rng.choice([0, 1, 5, min(2**bits, 2**63) - 1]) for _ in range(3)) for _ in range(500)]
    ids, (count,) = knlm.fold_grams([np.array(x, np.uint64) for x in zip(*grams, strict=True)], [np.ones(500, np.uint32)], bits)
    assert [(*map(int, g), int(c)) for *g, c in zip(*ids, count, strict=True)] == [(*g, c) for g, c in sorted(Counter(grams).items())]


@pytest.mark.parametrize("order", [2, 3])
def test_model_sums_to_one(spark, order):
    train = ["a b c a b", "b c d", "a a a"]
    model = knlm.train(frame(spark, train), Scratch(spark), order)
    probability = {}
    for w in ["a", "b", "c", "d", "zz"]:
        block = TextBlock(pa.array([f"a {w}"]), LOWER)
        probability[w] = 10 ** knlm.log_probs(block, model)[2][1]
    block = TextBlock(pa.array(["a"]), LOWER)
    assert sum(probability.values()) + 10 ** knlm.log_probs(block, model)[2][1] == pytest.approx(1)


# 4 SentencePiece


def test_sentencepiece(spark):
    c = spm.coder(spm.MODEL)
    rng = random.Random(7)
    texts = [*ODD, *(sentences_of(rng, 20) for _ in range(4)), "a" * 500, " " * 333, "日本語é" * 90, "thetheanion" * 60, "=-" * 200 + " end", "tab\tand\nline " * 40]
    ids = [*range(len(texts))]
    ids[3] = ids[4] = 1000
    rows = spm.encode(frame(spark, texts, ids), Scratch(spark), chunk=64, block=2).collect()
    want = sorted((i, c.whole.encode(t or "")) for i, t in zip(ids, texts, strict=True))
    assert sorted((r.doc_id, r.ids) for r in rows) == want
    by_ids = {tuple(c.whole.encode(t or "")): t or "" for t in texts}
    assert all(r.decoded_sha1 == hashlib.sha1(by_ids[tuple(r.ids)].encode()).hexdigest() for r in rows)
    assert all(r.score == pytest.approx(float(c.scores[r.ids].sum())) and r.n_pieces == len(r.ids) for r in rows)
    back = sorted(r.text for r in spm.decode(spm.encode(frame(spark, texts, ids), Scratch(spark))).collect())
    assert back == sorted(t or "" for t in texts)


def test_scan_is_associative():
    c = spm.coder(spm.MODEL)
    text = spm.MARK + "some wordswithout anyblanksatallinsidethem go here".replace(" ", spm.MARK)
    parts = [text[k : k + 9] for k in range(0, len(text), 9)]
    at = [(text[max(0, 9 * k - 256) : 9 * k], p, text[9 * k + 9 :][:256], k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
    m = [c.matrix(*x) for x in at]
    left = m[0]
    for x in m[1:]:
        left = spm.times(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = spm.times(x, right)
    assert left.keys() == right.keys() == {"0:"}
    (score,) = left["0:"].values()
    assert score == pytest.approx(c.score(c.ids(text)))


# 5 Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>if (a<b) x("</p>")</script></head><body class="page">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them all now please, thank you.</div><div class="ad">Buy this now, it is cheap and good!</div>{body}
<aside class="sidebar">Other stories, more of them, and others.</aside><form><label>Name</label><input name="q"><button>Send</button></form>
<div id="comments"><p>First! This comment is long enough to look like a paragraph, really.</p></div><footer>&copy; someone</footer></body></html>"""
TEXT = "A title Some text &amp; more, with <b>bold</b>ness &lt;here&gt;. Second one is here, with commas, and more."
CONTENT = "<h1>A title</h1><p>Some text &amp; more, with <b>bold</b>ness\n &lt;here&gt;.<p>Second one is   here, with commas, and more.</p>"
PLAIN = "A title Some text & more, with boldness <here>. Second one is here, with commas, and more."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<main role="main">{}</main>', '<div class="content">{}</div>', "<div><section>{}</section></div>"])
def test_page(wrap):
    assert htmltext.main_text(PAGE.format(body=wrap.format(CONTENT))) == PLAIN


SPLIT = "<h1>A title</h1><p>Some text &amp; more, with <b>bold</b>ness\n &lt;here&gt;.</p>", "<p>Second one is   here, with commas, and more.</p>"


@pytest.mark.parametrize(
    "body",
    [
        "<main>" + SPLIT[0] + "<article>" + SPLIT[1] + "</article></main>",
        "<article>" + SPLIT[0] + "</article><article>" + SPLIT[1] + "</article>",
    ],
)
def test_page_parts(body):
    assert htmltext.main_text(PAGE.format(body=body)) == PLAIN


def test_page_small_parts():
    words = "Many words stand in this part, with commas, and it is long. " * 30
    short = "Few words stand here, and they count."
    two = "<body><div class=part1><p>" + words + "</p></div><div class=part2><p>" + short + "</p></div></body>"
    assert htmltext.main_text(two) == words + short
    sections = "<body><main><h1>Title</h1><p>" + short + "</p><article><p>" + words + "</p></article></main></body>"
    assert htmltext.main_text(sections) == "Title " + short + " " + words.strip()
    apart = "<body><article><p>" + words + "</p></article><article><p>" + short + "</p></article></body>"
    assert htmltext.main_text(apart) == words + short
    for names in ("layout has-sidebar", "wrapper no-sidebar"):
        for wrap in ("{}", "<main>{}</main>", "<article>{}</article>"):
            body = f'<div class="{names}">' + wrap.format("<h1>Title</h1><p>" + words + "</p>") + '<div class="sidebar">Other stories.</div></div>'
            assert htmltext.main_text(PAGE.format(body=body)) == "Title " + words.strip()


def test_pages_odd(spark):
    pages = [None, "", "<html></html>", "plain words only", "<p>unclosed <b>bold<p>next", "<article><p>a<br>b</article>", "<article>x<!-- c > d --><script>no</script>y</article>", "<<<>>> <", "<article><div class='ad'>no</div>yes</article>", "<article>" + "<div>" * 3000 + "deep" + "</article>"]
    df = spark.createDataFrame([(i, f"u{i}", p, "z") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    want = ["", "", "", "plain words only", "unclosed bold next", "a b", "xy", None, "yes", "deep"]
    assert all(w is None or got[i] == (w, len(w)) for i, w in enumerate(want))


def bag_f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def article_of(page):
    """The text of the page's one article element, by the tag that the synthetic pages have."""
    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    return re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside)))).strip(" ")


def test_pages_without_telling_names(spark, monkeypatch):
    """article, nav, footer and the like made div, and class, id and role left out: the path scores find the text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(' (?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:article|main|section|nav|footer|header|aside|form)\b[^>]*>", r"<\1div>", x)) for x in pages]
    want = [article_of(x) for x in pages]
    assert [htmltext.main_text(x) for x in pages] == want
    assert sum(bag_f1(htmltext.main_text(x), w) for x, w in zip(plain, want, strict=True)) / len(pages) >= 0.95
    # The scores decide: with one score for all paths the menus and footers are in the text.
    real = htmltext.scores
    monkeypatch.setattr(htmltext, "scores", lambda paths: dict.fromkeys(real(paths), 1.0))
    assert all(htmltext.main_text(x) != w for x, w in zip(pages, want, strict=True))


def test_deep_pages():
    began = time.perf_counter()
    assert htmltext.main_text("<div>" * 100_000 + "word") == "word"
    assert htmltext.main_text("<div>word " * 20_000) == " ".join(["word"] * 20_000)
    htmltext.main_text("<div>" * 20_000 + "</section>" * 20_000)
    htmltext.main_text("<b>x" * 20_000 + "<p>y" * 20_000 + "</p><p>" * 20_000)
    assert time.perf_counter() - began < 10


def test_pages_rows(spark):
    """No rows, repeated rows, null ids, columns with the names of the result."""
    df = spark.createDataFrame([(None, None, "<p>one, two.</p>", "z", 1)] * 3 + [(7, "u", None, "z", 1)], "page_id long, url string, html string, text string, n_chars int")
    rows = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(df).collect()), key=str)
    assert rows == sorted([(None, None, "one, two.", 9)] * 3 + [(7, "u", "", 0)], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


# 6 Licenses


def plain_licenses(t):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    w = split(t)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = {}
    for (_, label, words), (_, _, whole) in zip(licenses._template_words(), licenses._templates(), strict=True):
        need, run = len(words) if len(words) < 12 else math.ceil(0.8 * len(words)), math.ceil(1.25 * len(whole))
        n = max((len(set(w[i : i + run]) & set(words)) for i in range(len(w))), default=0)
        if n >= need:
            best[label] = max(best.get(label, 0), n / len(words))
    base = sorted({x for _, x in at})
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *best})), max(best.values(), default=0.0))


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "the MIT-LICENSE and apache\nlicense, mit license", "GNU General Public License general public license", "under the License Apache licensed 2.0 Version the", "licensed under CC BY NC 4", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", licenses.TEMPLATES["bsd-notice"][0].upper(), "Permission is hereby granted to any person", "K license MIT LİCENSE"]
    texts += ["The film was released under a special license by the studio in 1990.", "word " * 20000 + licenses.TEMPLATES["isc-notice"][0] + " word" * 20000, *licenses.TEMPLATES["bsd-notice"] * 2]
    ids = [*range(len(texts))]
    ids[2] = ids[3] = None
    ids[6] = ids[7] = 500
    rows = licenses.scan(frame(spark, texts, ids)).collect()
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(((r.doc_id, *(r[c] for c in cols)) for r in rows), key=str) == sorted(((i, *plain_licenses(t)) for i, t in zip(ids, texts, strict=True)), key=str)


def test_licenses_wrapped(spark):
    notices = [(label, x) for label, texts in licenses.TEMPLATES.items() for x in texts]
    pad = "Some words of another kind stand before and after it. " * 3
    wrap = lambda x, width: textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)
    cases = [(label, x, width, sign) for label, x in notices for width in (40, 72, 80, 100) for sign in ("", "# ", " * ")]
    texts = ["\n".join(sign + line for line in [pad, *wrap(x, width), pad]) for _, x, width, sign in cases]
    # Neither all words far apart nor too few of them together are a notice.
    words = notices[1][1].split()
    texts += [("\n" + pad).join(words), "\n".join(wrap(" ".join(words[:16]), 72))]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(frame(spark, texts)).collect()}
    assert [(x, got[i]) for i, x in enumerate(cases) if x[0] not in got[i][0] or got[i][1] != 1] == []
    assert got[len(cases)] == got[len(cases) + 1] == ([""], 0)


def test_licenses_empty(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


# 7 Near duplicates


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set())
    return out


def plain_components(ids, texts):
    sets, root = plain_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and ids[i] is not None and ids[j] is not None and 100 * n >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return sorted(((x, len(sets[i]), None if x is None else least[find(i)]) for i, x in enumerate(ids)), key=str)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("leaf", "heavy"), [(256, 64), (4, 3)])
def test_near_duplicates(spark, monkeypatch, leaf, heavy):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PART", max(2, leaf // 2))
    monkeypatch.setattr(jaccard, "PIVOTS", 3 if leaf < 256 else 16)
    monkeypatch.setattr(jaccard, "LEAST_HEAVY", heavy)
    rng = random.Random(8)
    base = [sentences_of(rng, rng.randint(2, 30)) for _ in range(12)]
    passage = sentences_of(rng, 4)
    texts = [*ODD, *base, *base[:3], *(edited(rng, b, rng.randint(1, 12)) for b in base for _ in range(6)), *(f"{passage} {sentences_of(rng, 1)}" for _ in range(25)), *(edited(rng, base[0], 3) for _ in range(25))]
    ids = rng.sample(range(1000), len(texts))
    ids[0], ids[5] = None, None
    rows = jaccard.near_duplicates(frame(spark, texts, ids)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == plain_components(ids, texts)


def found_links(spark, docs, percent=75):
    scratch = Scratch(spark)
    met = scratch.save(jaccard.candidates(docs, 5, percent), "met")
    sets = scratch.save(jaccard.shingle_table(docs, met, 5, percent), "sets")
    heavy = jaccard.heavy_shingles(sets, scratch)
    nodes = scratch.save(jaccard.shared_sets(sets, percent, heavy), "nodes")
    return scratch, sets, scratch.save(jaccard.links(nodes, scratch, percent, heavy), "links")


def test_windows_of_the_documents_table(spark):
    """With production parameters, pivots link part of what is linked, and windows replicate part of that into the joins."""
    scratch, _, links = found_links(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    far, window = (spark.read.parquet(f"{scratch.root}/{x}0") for x in ("far", "window"))
    assert far.where("linked and node <> pivot").count() > 50
    replicas, beyond = window.where("linked").count(), window.where("not linked").count()
    assert replicas > 0 and beyond > 0 and window.count() < far.count()
    assert links.count() > far.where("linked and node <> pivot").count()


def test_voronoi_regions(spark, monkeypatch):
    """All sets in one region at first: it is divided by nearest pivots, boundary sets stand in several regions, and nothing is lost."""
    monkeypatch.setattr(jaccard, "LEAF", 12)
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 8)
    monkeypatch.setattr(jaccard, "regions", lambda nodes, heavy: nodes.crossJoin(nodes.agg(F.min("node").alias("pivot"))).select("pivot", "node"))
    rng = random.Random(14)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(7):
            w = base[:]
            for k in rng.sample(range(60), 2):
                w[k] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = frame(spark, texts)
    scratch, _, _ = found_links(spark, docs.select("doc_id", "text"))
    large, cells = spark.read.parquet(f"{scratch.root}/members1"), spark.read.parquet(f"{scratch.root}/far1")
    assert large.count() > 12 and cells.select("cell").distinct().count() > cells.select("region").distinct().count()
    assert cells.groupBy("region", "node").count().where("count > 1").count() > 0
    rows = jaccard.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == plain_components([*range(len(texts))], texts)


def variants(rng, n, words, edits):
    """A text and copies of it with up to so many words put in place of others, of few words, so that some edits agree."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)] if n % 2 else []
    while len(out) < n:
        w = base[:]
        for k in rng.sample(range(words), rng.randint(1, edits)):
            w[k] = f"e{rng.randrange(40)}"
        out.append(" ".join(w[: words - rng.randint(0, 2)]))
    return out


def test_rows_for_a_large_group_of_variants(spark, monkeypatch):
    """Of one text's variants, all about as far from each other, none is led to many cells or blocks; what is beyond the threshold stays apart."""
    monkeypatch.setattr(jaccard, "LEAF", 32)
    monkeypatch.setattr(jaccard, "PART", 16)
    texts = variants(random.Random(31), 301, 120, 9)
    docs = frame(spark, texts)
    scratch, _, _ = found_links(spark, docs.select("doc_id", "text"))
    tables = [x for x in os.listdir(scratch.root.removeprefix("file://")) if re.fullmatch("(far|window|settled|under|weak)[1-9]", x)]
    led = sum(spark.read.parquet(f"{scratch.root}/{x}").count() for x in tables)
    assert 0 < led < 4 * spark.read.parquet(f"{scratch.root}/members1").count()
    want = plain_components([*range(len(texts))], texts)
    assert len({x for _, _, x in want}) > 20
    rows = jaccard.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want


@pytest.mark.parametrize(("leaf", "percent", "words"), [(6, 75, 40), (5, 60, 60)])
def test_variants_against_all_pairs(spark, monkeypatch, leaf, percent, words):
    """Blocks of weak members and regions that are settled again, with several groups in a region and other thresholds."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rng = random.Random(leaf)
    texts = [x for n in (60, 41, 9) for x in variants(rng, n, words, max(4, words // 12))]
    sets, root = plain_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    rows = jaccard.near_duplicates(frame(spark, texts), percent=percent).collect()
    assert [x.component_id for x in sorted(rows, key=lambda x: x.doc_id)] == root


def test_meetings_known_in_a_task():
    h = np.array([7, 7, 7, 9, 9, 4, 4], np.uint64)
    doc = np.array([2, 5, 5, 5, 2, 8, 8])
    key, ids, met = jaccard._meet_here(h, doc, np.zeros(7, np.uint32))
    assert sorted(zip(ids.tolist(), met.tolist(), strict=True)) == [(2, 1), (2, 1), (5, 3), (8, 0)]
    assert sorted(key[:3].tolist()) == [4, 7, 9]


def test_near_duplicates_empty_and_repeated_rows(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    rows = jaccard.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "other"], [3, 3, 5])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (3, 3), (5, 5)]


def test_first_of_a_component_stays(spark):
    """Rows of one id are decided by their texts, repeated rows stay once, and no null is dropped."""
    rng = random.Random(21)
    one, two, three, four = (sentences_of(rng, 8) for _ in range(4))
    rows = [(3, one), (5, edited(rng, one, 1)), (5, two), (5, two), (7, two), (8, three), (8, three), (8, three), (None, three), (None, three), (9, None), (10, None), (11, ""), (12, "a b"), (13, "A B"), (2, four), (4, four)]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = jaccard.keep_first(docs.withColumnRenamed("score", "_key").withColumnRenamed("lang", "_row"))
    assert got.columns == ["doc_id", "text", "_row", "_key", "_id", "_first"]
    want = [(3, one), (5, two), (8, three), (None, three), (None, three), (9, None), (10, None), (11, ""), (12, "a b"), (2, four)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_shingles():
    block = TextBlock(pa.array([*ODD, "a b c d e f a b c d e"], pa.string()), LOWER)
    doc, _ = shingle_sets(block)
    assert np.bincount(doc, minlength=block.n).tolist() == [len(s) for s in plain_sets([*ODD, "a b c d e f a b c d e"])]


# 8 Spans


def plain_units(t):
    """The words of each sentence, read off the text character by character."""
    found, line = [], []
    for piece in re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or ""):
        word = WORD.match(piece)[0]
        line.append(lower(word))
        if word[-1] in ".!?" or "\n" in piece:
            found.append(line)
            line = []
    if line:
        found.append(line)
    out = []
    for sentence in found:
        part = []
        for w in sentence:
            part.append(w)
            if len(sentence) > 30 and w[-1] in ",;:|":
                out.append(tuple(part))
                part = []
        if part:
            out.append(tuple(part))
    return out


def plain_spans(t):
    units = plain_units(t)
    out = set()
    enough = lambda x: any(len(x) >= m and sum(map(len, x)) >= w for m, w in ((3, 20), (2, 30), (1, 50)))
    for i in range(len(units)):
        out |= {(i, j) for j in range(i, len(units)) if enough(units[i : j + 1]) and not any(enough(units[i : k + 1]) for k in range(i, j))}
        out |= {(j, i) for j in range(i + 1) if enough(units[j : i + 1]) and not any(enough(units[k : i + 1]) for k in range(j + 1, i + 1))}
    return units, out


def plain_repeats(rows):
    """The numbers of the sentences to remove, by document."""
    first, found = {}, []
    for i, t in sorted(rows):
        units, at = plain_spans(t)
        for a, z in sorted(at):
            found.append((i, a, z, tuple(w for u in units[a : z + 1] for w in u)))
            first.setdefault(found[-1][3], (i, a))
    gone = defaultdict(set)
    for i, a, z, h in found:
        if first[h] != (i, a):
            gone[i] |= set(range(a, z + 1))
    return gone


def test_spans(spark):
    rng = random.Random(9)
    passage = sentences_of(rng, 7)
    texts = [*ODD, *(sentences_of(rng, 6) for _ in range(6))]
    texts += [f"{sentences_of(rng, 3)} {passage}\n{sentences_of(rng, 2)}" for _ in range(5)] + [passage, texts[-1], f"{passage}\n\n{passage}"]
    listed = " | ".join(f"item{k} of a table, number {k}" for k in range(40))
    texts += [f"{sentences_of(rng, 1)} {listed} {sentences_of(rng, 2)}" for _ in range(2)] + [f"  {passage} {sentences_of(rng, 1)} ", "no end of a sentence " * 30, "x " + "no end of a sentence " * 30]
    ids = rng.sample(range(500), len(texts))
    gone = plain_repeats(zip(ids, texts, strict=True))
    docs = frame(spark, texts, ids)
    out = spans.remove(docs, spans.repeats(docs, Scratch(spark)))
    assert out.columns == [*docs.columns, "_sentences", "_removed"]
    assert {(r.lang, r.score, r._id, r._first) for r in out.collect()} == {("en", 9.9, "x", 7)}
    text_of = dict(zip(ids, texts, strict=True))
    assert any(gone.values())
    for r in out.collect():
        units = plain_units(text_of[r.doc_id])
        assert (r._sentences, r._removed) == (len(units), len(gone[r.doc_id]))
        assert WORD.findall(lower(r.text)) == [w for k, u in enumerate(units) if k not in gone[r.doc_id] for w in u]
        assert gone[r.doc_id] or r.text == text_of[r.doc_id]


def test_spans_rows_of_one_id(spark):
    rng = random.Random(8)
    texts = [sentences_of(rng, k) for k in (12, 4, 9, 1, 7)]
    copy = sentences_of(rng, 4)
    # Null ids and an equal id with different texts: only the copies go, all but one of them.
    for ids in ([None] * 6, [5] * 6):
        docs = frame(spark, [texts[0] + " " + copy, copy + " " + texts[1], texts[2], texts[3], texts[4], texts[4]], ids)
        out = spans.remove(docs, spans.repeats(docs, Scratch(spark)))
        got = sorted((r.text, r._removed > 0) for r in out.collect())
        one, two = (texts[0], texts[1]), texts[0] + " " + copy
        assert got in (sorted([(x, False) for x in (two, *texts[2:], texts[4])] + [(one[1], True)]), sorted([(x, False) for x in (copy + " " + one[1], *texts[2:], texts[4])] + [(one[0] + " ", True)]))


# 9 WARC


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    bodies = ["<p>a</p>", None, "", "é" * 5000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 2500, "<p>a</p>", ""]
    df = spark.createDataFrame([(10 - i, f"http://h/{i}", b, "k") for i, b in enumerate(bodies)], "page_id long, url string, html string, record_type string").repartition(3)
    scratch = Scratch(spark)
    archives = warc.write(df, scratch)
    rows = {r.page_id: r for r in warc.records(archives).collect()}
    first = {}
    for i, b in sorted(((10 - i, b or "") for i, b in enumerate(bodies))):
        first.setdefault(b, i)
        r, data = rows[i], b.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[b] == i else ("revisit", first[b]))
    assert len(rows) == len(bodies)
    chunks = warc.chunk_table(archives, 1000).where("record_type = 'response'").orderBy("record_id", "chunk_no").collect()
    whole = defaultdict(bytes)
    for c in chunks:
        assert len(c.data) <= 1000 and c.offset == len(whole[c.record_id])
        whole[c.record_id] += c.data
        assert c.digest == base64.b32encode(hashlib.sha1(whole[c.record_id]).digest()).decode() and c.is_last == (len(whole[c.record_id]) == c.said_bytes)
    assert sorted(whole.values()) == sorted({(b or "").encode() for b in bodies})
    assert warc.records(warc.write(df.limit(0), Scratch(spark))).count() == 0


def test_warc_rows(spark):
    """Null ids, repeated rows, an empty url, no rows, a damaged archive."""
    rows = [(None, "u", "x"), (None, "u", "x"), (3, None, "y"), (3, None, "y"), (4, "a  b", "y"), (5, "u", None), (6, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    scratch = Scratch(spark)
    archives = warc.write(df, scratch)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.records(archives).collect()), key=str)
    want = [(None, 1, "revisit", 6), (None, 1, "revisit", 6), (3, 1, "response", None), (3, 1, "response", None), (4, 1, "revisit", 3), (5, 0, "response", None), (6, 1, "response", None)]
    assert got == sorted(want, key=str)
    path = archives.first().path
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception, match="archive|Error|damaged"):
        warc.records(archives).collect()


def test_warc_large_payload(spark, tmp_path):
    """A payload of 64 MB is written and read in chunks; the reader never holds more than a few of them."""
    import tracemalloc

    df = spark.range(1).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789abcdef', 4194304) AS html")
    archives = warc.write(df, Scratch(spark))
    r = warc.records(archives).first()
    assert (r.payload_bytes, r.payload_digest) == (1 << 26, base64.b32encode(hashlib.sha1(b"0123456789abcdef" * 4194304).digest()).decode())
    tracemalloc.start()
    n = sum(1 for _ in warc.chunks(archives.first().path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (1 << 26) // warc.CHUNK and peak < 8 * warc.CHUNK


# 10 Decontamination


def plain_tiles(item, doc, least):
    """Greedy string tiling without hashes."""
    a, b, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and a[i + k] and b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return total
        k, i, j = best
        a[i : i + k], b[j : j + k] = [False] * k, [False] * k
        total += k


def test_tiling(monkeypatch):
    rng = random.Random(10)
    for turn in range(400):
        monkeypatch.setattr(decontam, "PAIRS_AT_ONCE", 7 if turn % 2 else 2_000_000)
        n = rng.choice([1, 2, 3, 8])
        item, doc = [rng.randrange(n) for _ in range(rng.randint(1, 25))], [rng.randrange(n) for _ in range(rng.randint(0, 40))]
        tiles = decontam.tile(item, doc, 3)
        assert all(item[i : i + k] == doc[j : j + k] and k >= 3 for i, j, k in tiles)
        for side in (0, 1):
            used = [t[side] + d for t in tiles for d in range(t[2])]
            assert len(used) == len(set(used))
        assert sum(t[2] for t in tiles) == plain_tiles(item, doc, 3)


def plain_contaminated(docs, items, least=5, coverage=0.5):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for d, t in docs:
        for x, u in items:
            w = split(u)
            if w:
                n = plain_tiles(w, split(t), min(least, len(w)))
                if n and n >= coverage * len(w):
                    out.append((d, x, n / len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "bits"), [("long", 27), ("string", 6)])
def test_decontamination_against_plain_tiling(spark, monkeypatch, kind, bits):
    """Common phrases, short and repeated items, null and repeated ids, ids that are strings; with a filter that lets all pass."""
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    phrase = say(6)
    items = [f"{say(9)} {phrase} {say(8)}" for _ in range(10)] + [phrase, "w1 w2", None, "", "x y", "a " * 9, say(300)]
    items += [items[0]]
    shuffled = lambda t: " ".join(w for part in rng.sample([t.split()[:8], t.split()[8:15], t.split()[15:]], 3) for w in [*part, "zz"])
    texts = [None, "", "x y", phrase, *(f"{say(20)} {phrase} {say(20)}" for _ in range(20)), *(f"{say(5)} {shuffled(items[k])} {say(5)}" for k in range(10)), items[2] + "\n" + items[2], "A a-a " * 40, items[-2], f"{items[0]} {items[1][:20]}"]
    ids = [*range(len(texts))]
    ids[4] = ids[5] = None
    ids[6] = ids[7] = 900
    name = (lambda x: x if x is None else f"n{x}") if kind == "string" else (lambda x: x)
    docs = spark.createDataFrame([(name(i), t, "x", 1) for i, t in zip(ids, texts, strict=True)] + [(name(20), texts[20], "x", 1)], f"doc_id {kind}, text string, _key string, item int").repartition(3)
    bench = spark.createDataFrame([(name(k), t) for k, t in enumerate(items)] + [(name(3), items[3])], f"item_id {kind}, text string")
    got = sorted(((r.doc_id, r.item_id, r.coverage) for r in decontam.contaminated(docs, bench).collect()), key=str)
    rows = [(name(i), t) for i, t in zip(ids, texts, strict=True)] + [(name(20), texts[20])]
    want = plain_contaminated(rows, [*((name(k), t) for k, t in enumerate(items)), (name(3), items[3])])
    assert got == want and len(want) > 30
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    clean = [t for i, t in rows if not plain_contaminated([(i, t)], [*enumerate(items)])]
    assert sorted(map(str, clean)) == sorted(str(r.text) for r in kept.collect())
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(11)
    items = [sentences_of(rng, 4) for _ in range(8)] + [None, "", "tiny item", sentences_of(rng, 4)]
    w = items[1].split()
    half = len(w) // 2
    texts = [*ODD, f"{sentences_of(rng, 5)} {items[0].upper()} {sentences_of(rng, 5)}", " ".join(w[half:]) + " other words between " + " ".join(w[:half]), f"x {items[2][: len(items[2]) // 4]} y", f"{items[3]}\n{items[4]}", "a TINY-item here", *(sentences_of(rng, 10) for _ in range(10))]
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    n = len(ODD)
    assert sorted(rows) == [(n, 0), (n + 1, 1), (n + 3, 3), (n + 3, 4), (n + 4, 10)]
    assert rows[n + 1, 1].n_tiles == 2 and rows[n + 1, 1].coverage == 1


# Pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    gone = []
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark).save(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        gone.append(docs.count() - out.count())
        docs = out
    assert gone[1] > 0 and gone[3] > 0 and gone[4] == 0


def plain_pipeline(rows, items):
    """(doc_id, token ids) of the documents (doc_id, text, lang) that are kept, stage by stage."""
    train = [(t, x) for i, t, x in rows if t is not None and x is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    lang = plain_language(list(dict.fromkeys(train)), [t for _, t, _ in rows])
    docs = [(i, t) for (i, t, _), (x, _) in zip(rows, lang, strict=True) if x != "und"]
    known = [(i, t) for i, t in dict.fromkeys(docs) if i is not None]
    first = {(i, c) for i, _, c in plain_components(*zip(*known, strict=True))}
    docs = [(i, t) for i, t in known if (i, i) in first] + [(i, t) for i, t in docs if i is None]
    gone, out = plain_repeats((i, t) for i, t in docs if i is not None), []
    for i, t in docs:
        sizes = [len(u) for u in plain_units(t)]
        starts = [m.start() for m in WORD.finditer(t)]
        edges = [*(starts[sum(sizes[:k])] for k in range(len(sizes))), len(t)]
        lost = gone[i] if i is not None else set()
        if not sizes or len(lost) < len(sizes):
            out.append((i, t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(sizes)) if k not in lost)))
    encode = spm.coder(spm.MODEL).whole.encode
    return sorted(((i, encode(t)) for i, t in out if not plain_contaminated([(i, t)], items)), key=str)


def test_pipeline_against_plain_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(22)
    vocab = {"en": [f"the{k} of" for k in range(150)], "de": [f"über{k} der" for k in range(150)]}

    def say(lang, n):
        return " ".join(" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(4, 7))) + "." for _ in range(n))

    base = [(say(x, rng.randint(3, 9)), x) for x in ("en", "de") for _ in range(16)]
    passage, items = say("en", 7), [(k, say("en", 3)) for k in range(6)] + [(6, None), (7, ""), (8, "tiny item")]
    texts = [*base, *base[:4], *((edited(rng, t, 1), x) for t, x in base[:8])]
    texts += [(f"{say(x, 4)} {passage} {say(x, 3)}", x) for x in ("en", "de") * 4] + [(passage, "en")]
    texts += [(f"{say('de', 2)} {items[k][1].upper()} {say('de', 2)}", "de") for k in range(4)] + [("some tiny-item here", None)]
    texts += [(t, None) for t in (None, "", " \n ", "12 34 !", "a", "of", "日本語 der")]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, x) for i, (t, x) in zip(ids, texts, strict=True)]
    rows += [rows[5], rows[5], (None, say("en", 4), "en"), (None, "no id at all", None), (rows[9][0], say("de", 5), "de")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "_key": pa.array([1] * len(rows)), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    bench = pa.table({"item_id": pa.array([k for k, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(bench, tmp_path / "benchmark.parquet")
    got = sorted(((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want = plain_pipeline(rows, items)
    assert got == want and 25 < len(want) < len(rows) - 20
    empty = tmp_path / "empty"
    empty.mkdir()
    pq.write_table(table.slice(0, 0), empty / "documents.parquet")
    pq.write_table(bench, empty / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
