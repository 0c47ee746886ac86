"""Quality rules as a short-circuit cascade.

Every rule's cost (time a document) and selectivity (share it rejects) are measured on those of a
bounded sample that pass the base test, as in the cascade; each rule pays for what it needs beyond the base measures, which
are reported for all documents. Rules then run in order of rejection per cost, each only on the documents
that all earlier ones let pass: once those are less than half of a block, they are cut out into a block of their own. The verdict is
the same for every order, so a different measurement changes speed alone.

Defined cases: a null or empty text has no words, fails the base test and is not kept.
Lines are split at \\n alone. Of rules that reject a text equally soon the order decides which is named. Ids may be null or
repeat; repeated rows each get their own row. Very long texts are blocks of their own, and are not in the sample.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import SPACE, U64, TextBlock, blocks, mix, window_hash

#: Documents that the sample for costs and selectivities has at most, and bytes of each: 64 MB in all.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 16
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_TAIL = np.ones(256, bool)
_NOT_TAIL[0x80:0xC0] = False
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


class Measures:
    """What rules look at, computed when first asked for."""

    def __init__(self, block: TextBlock):
        self.block = block
        self._kept: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def per_doc(self, of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_words, dtype=np.int64)])
        at = self.block.words_at
        return total[at[1:]] - total[at[:-1]]

    def _n_words(self) -> np.ndarray:
        return self.block.n_words.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        return self.block.sums(_NOT_TAIL[self.block.buf] & ~SPACE[self.block.buf])

    def _n_symbols(self) -> np.ndarray:
        return self.block.sums(_SYMBOL[self.block.buf])

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of each line that has a word."""
        b = self.block
        breaks = np.flatnonzero(b.buf == 10)
        start = np.sort(np.concatenate([b.off[:-1], breaks + 1]))
        end = np.sort(np.concatenate([b.off[1:], breaks]))
        full = np.searchsorted(b.start, start) < np.searchsorted(b.start, end)
        start, end = start[full], end[full]
        return np.searchsorted(b.off, start, side="right") - 1, start, end

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.get("lines")[0], minlength=self.block.n)

    def _n_dup_lines(self) -> np.ndarray:
        doc, start, end = self.get("lines")
        h = mix(self.block.span_hash(start, end) + mix(doc.astype(U64)))
        first = np.zeros(len(h), bool)
        first[np.unique(h, return_index=True)[1]] = True
        return np.bincount(doc[~first], minlength=self.block.n)

    def _line_marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of each line that has a word, whether it starts with a bullet, and whether it ends with an ellipsis."""
        b = self.block
        doc, start, end = self.get("lines")
        first, last = b.start[np.searchsorted(b.start, start)], b.end[np.searchsorted(b.start, end) - 1]
        buf = np.concatenate([np.zeros(3, np.uint8), b.buf, np.zeros(3, np.uint8)])
        three = lambda at: (buf[at].astype(np.uint32) << 16) | (buf[at + 1].astype(np.uint32) << 8) | buf[at + 2]
        head, tail = three(first + 3), three(last)
        bullet = np.isin(head >> 16, list(b"-*")) | (head == int.from_bytes("•".encode()))
        return doc, bullet, (tail == int.from_bytes(b"...")) | (tail == int.from_bytes("…".encode()))

    def _words(self) -> np.ndarray:
        return self.block.word_hash()

    def _n_repeat_words(self) -> np.ndarray:
        return self.per_doc(repeated_positions(self.get("words"), self.block.doc, 3))

    def _n_alpha_words(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_ALPHA[self.block.buf])])
        return self.per_doc(total[self.block.end] > total[self.block.start])


def repeated_positions(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-word window that its text has twice or more."""
    out = np.zeros(len(words), bool)
    h = window_hash(words, k)
    if len(h):
        inside = np.flatnonzero(doc[: len(h)] == doc[k - 1 :])
        key = mix(h[inside] + mix(doc[inside].astype(U64)))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for j in range(k):
            out[at + j] = True
    return out


def base_failed(m: Measures) -> np.ndarray:
    return (m.get("n_words") < MIN_WORDS) | (100 * m.get("n_repeat_words") > 50 * m.get("n_words"))


def _word_length(m: Measures, docs: np.ndarray) -> np.ndarray:
    n, c = m.get("n_words")[docs], m.get("word_chars")[docs]
    return (c < 2 * n) | (c > 15 * n)


def _symbols(m: Measures, docs: np.ndarray) -> np.ndarray:
    return 10 * m.get("n_symbols")[docs] > m.get("n_words")[docs]


def _dup_lines(m: Measures, docs: np.ndarray) -> np.ndarray:
    return 10 * m.get("n_dup_lines")[docs] > 3 * m.get("n_lines")[docs]


def _alpha_words(m: Measures, docs: np.ndarray) -> np.ndarray:
    return 10 * m.get("n_alpha_words")[docs] < 8 * m.get("n_words")[docs]


def _chosen(m: Measures, docs: np.ndarray) -> np.ndarray:
    pick = np.zeros(m.block.n, bool)
    pick[docs] = True
    return pick[m.block.doc]


def _top_word(m: Measures, docs: np.ndarray) -> np.ndarray:
    """Only the words of the documents still in the cascade are sorted."""
    mine = _chosen(m, docs)
    key = mix(m.get("words")[mine] + mix(m.block.doc[mine].astype(U64)))
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(m.block.n, np.int64)
    np.maximum.at(top, m.block.doc[mine][first], n)
    return 10 * top[docs] > 3 * m.get("n_words")[docs]


def _top_pair(m: Measures, docs: np.ndarray) -> np.ndarray:
    """The same for pairs of consecutive words."""
    pair = window_hash(m.get("words"), 2)
    doc = m.block.doc[: len(pair)]
    mine = _chosen(m, docs)[: len(pair)] & (doc == m.block.doc[1 : len(pair) + 1])
    _, first, n = np.unique(mix(pair[mine] + mix(doc[mine].astype(U64))), return_index=True, return_counts=True)
    top = np.zeros(m.block.n, np.int64)
    np.maximum.at(top, doc[mine][first], n)
    return 10 * top[docs] > 2 * m.get("n_words")[docs]


def _lines_with(mark: int, times: int) -> Callable[[Measures, np.ndarray], np.ndarray]:
    def rejects(m: Measures, docs: np.ndarray) -> np.ndarray:
        doc, *marks = m.get("line_marks")
        return 10 * np.bincount(doc[marks[mark]], minlength=m.block.n)[docs] > times * m.get("n_lines")[docs]

    return rejects


#: name -> rejects(measures, numbers of the documents still in)
RULES: dict[str, Callable[[Measures, np.ndarray], np.ndarray]] = {
    "word_length": _word_length,
    "symbols": _symbols,
    "dup_lines": _dup_lines,
    "alpha_words": _alpha_words,
    "top_word": _top_word,
    "top_pair": _top_pair,
    "bullets": _lines_with(0, 9),
    "ellipses": _lines_with(1, 3),
}


def cut_out(block: TextBlock, docs: np.ndarray) -> TextBlock:
    """A block of these texts alone."""
    return TextBlock(pa.array([block.raw[block.off[i] : block.off[i + 1]].tobytes() for i in docs], pa.large_binary()).cast(pa.large_string()))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(block: TextBlock) -> Measures:
    """Measures with those that every document gets, and the words' hashes, already there."""
    m = Measures(block)
    for name in (*BASE, "words"):
        m.get(name)
    return m


def measure_rules(docs: DataFrame, rules: dict[str, Callable] | None = None, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Names of the rules, the one with the most rejections for its cost first."""
    rules = rules or RULES

    # take() reads no more partitions than it needs; the rules are tried on these few texts here.
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).where(F.octet_length("text") <= SAMPLE_BYTES).take(sample_docs)
    cost, bad = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for at in range(0, len(few), 200):
        block = TextBlock(pa.array([r.text for r in few[at : at + 200]], pa.large_string()))
        left = np.flatnonzero(~base_failed(Measures(block)))
        if not len(left):
            continue
        block, left = cut_out(block, left), np.arange(len(left))
        for name, rule in rules.items():
            m = with_base(block)
            began = time.perf_counter()
            bad[name] += int(rule(m, left).sum())
            cost[name] += time.perf_counter() - began
    return sorted(rules, key=lambda x: (-bad[x] / max(cost[x], 1e-9), cost[x], x))


def cascade(docs: DataFrame, order: list[str], rules: dict[str, Callable] | None = None) -> DataFrame:
    """The measures, verdict, rejecting rule and number of rules run of every row."""
    rules = rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            m = now = with_base(block)
            failed = base_failed(m)
            left = np.flatnonzero(~failed)
            place = left  # of the documents left, in the block that now holds them
            by, ran = np.where(failed, "base", None).astype(object), np.zeros(block.n, np.int32)
            for name in order:
                if not len(left):
                    break
                if 2 * np.diff(now.block.off)[place].sum() < len(now.block.buf):
                    now, place = Measures(cut_out(now.block, place)), np.arange(len(place))
                bad = rules[name](now, place)
                ran[left] += 1
                by[left[bad]] = name
                left, place = left[~bad], place[~bad]
            kept = np.zeros(block.n, bool)
            kept[left] = True
            cols = [batch.column("doc_id"), *(pa.array(m.get(x).astype(np.int64)) for x in BASE), pa.array(failed), pa.array(kept), pa.array(list(by), pa.string()), pa.array(ran)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "kept", "rejected_by", "rules_run"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean, rejected_by string, rules_run int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
