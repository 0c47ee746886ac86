"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The pieces and scores come from a model file; the ids equal those of the sentencepiece
library on the whole text. Texts of up to CHUNK characters are encoded as they are.

A longer text is split into chunks at fixed places. What crosses a chunk's edge is its state:
the piece that ends at or after the edge, and how far it reaches beyond. Of every chunk a
matrix says, for each state at its left edge and each at its right, the best total score of
the pieces between them (minus infinity if there is none): matrices are multiplied by
(max, +), which is associative, so blocks of chunks are multiplied in parallel, then blocks of
blocks for the whole text, and the states so found at block edges are pushed down to all
edges. Each chunk is then backtraced on its own from its two states.

A path may step from one piece to the next only if the pair, encoded alone, stays that pair.
Merging happens in order of score and then place, so a sequence of pieces is the library's
encoding exactly if each neighbouring pair is; one path alone has a finite score, and the
scan finds it. In a chunk that has white space the first and last words alone depend on the
states, and what stands between is common to all paths.

Defined cases: a null text is empty; an empty text has no pieces, score 0. Rows with equal
ids, or null ids, each keep their own result. U+2581 in a text decodes as a blank, as in the
library. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import Scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and chunks of a block of the scan.
CHUNK, BLOCK = 16_384, 64
MARK = "▁"


class Coder:
    """A model file, with and without the mark put before a text."""

    def __init__(self, model: str):
        import sentencepiece

        with open(model, "rb") as f:
            data = f.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Field 3 (normalizer) of the message, its field 3 (add_dummy_prefix) set to 0: the last value of a field holds.
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x02\x18\x00")
        n = self.whole.vocab_size()
        self.scores = np.array([self.whole.get_score(i) for i in range(n)])
        self.length = np.zeros(n, np.int64)
        self.pieces: dict[str, int] = {}
        for i in range(n):
            if self.whole.is_byte(i):
                b = int(self.whole.id_to_piece(i)[3:5], 16)
                self.length[i] = not 0x80 <= b < 0xC0  # a character counts at its first byte
            elif not (self.whole.is_control(i) or self.whole.is_unknown(i) or self.whole.is_unused(i)):
                piece = self.whole.id_to_piece(i)
                self.length[i] = len(piece)
                if self.raw.encode(piece) == [i]:
                    self.pieces[piece] = i
        self.longest = int(self.length.max())

    def ids(self, text: str) -> list[int]:
        return self.raw.encode(text)

    def units(self, ids: list[int]) -> list[list[int]]:
        """Pieces; the bytes of one character are together."""
        out: list[list[int]] = []
        for i in ids:
            if self.length[i] or not out:
                out.append([i])
            else:
                out[-1].append(i)
        return out

    def score(self, ids: list[int]) -> float:
        return float(self.scores[ids].sum()) if ids else 0.0

    def states(self, left: str, right: str) -> list[str]:
        """States at the edge between two texts: how far the crossing piece reaches, and the piece."""
        text, at, found = left[-self.longest :] + right[: self.longest], min(len(left), self.longest), []
        for begin in range(at):
            for end in range(at, min(len(text), begin + self.longest) + 1):
                piece = text[begin:end]
                if piece in self.pieces or (end == at and begin == at - 1 and len(self.units(self.ids(piece))) == 1):
                    found.append(f"{end - at}:{piece}")
        return found

    def path(self, left: str, body: str, right: str, to: str, inner: list[int] | None = None) -> list[int] | None:
        """Ids after the piece of state `left` up to and with that of state `to`, or None. inner: those between the first and the last cut, if known."""
        reach, piece = _state(left)
        over, last = _state(to)
        cuts = self.cuts(body)
        text = body + right[:over]
        if cuts and cuts[0] >= reach and cuts[1] <= len(body) - (len(last) - over):
            head = self._after(piece, body[reach : cuts[0]])
            tail = self.ids(text[cuts[1] :])
            if head is None or not self._ends(tail, last):
                return None
            return head + (self.ids(body[cuts[0] : cuts[1]]) if inner is None else inner) + tail
        ids = self._after(piece, text[reach:])
        if ids is None or not self._ends(ids, last):
            return None if ids is None or ids or (over, last) != (reach - len(body), piece) else []
        return ids

    def _after(self, piece: str, text: str) -> list[int] | None:
        ids = self.ids(piece + text)
        first = self.ids(piece) if piece else []
        return ids[len(first) :] if ids[: len(first)] == first else None

    def _ends(self, ids: list[int], last: str) -> bool:
        own = self.ids(last)
        return ids[len(ids) - len(own) :] == own

    @staticmethod
    def cuts(body: str) -> tuple[int, int] | None:
        """First and last place where a word starts after another character: no piece reaches over it."""
        first = next((i for i in range(1, len(body)) if body[i] == MARK and body[i - 1] != MARK), None)
        if first is None:
            return None
        last = next(i for i in range(len(body) - 1, 0, -1) if body[i] == MARK and body[i - 1] != MARK)
        return first, last

    def matrix(self, left: str, body: str, right: str, first: bool, final: bool) -> dict:
        """Sparse matrix of a chunk: scores between left and right states."""
        cuts = self.cuts(body)
        inner = self.ids(body[cuts[0] : cuts[1]]) if cuts else None
        rows = ["0:"] if first else self.states(left, body)
        columns = [s for s in self.states((left if not first else "") + body, right if not final else "") if not final or s.startswith("0:")]
        out: dict[str, dict[str, float]] = {}
        for a in rows:
            for b in columns:
                ids = self.path(a, body, right, b, inner)
                if ids is not None:
                    out.setdefault(a, {})[b] = self.score(ids)
        return out


def _state(s: str) -> tuple[int, str]:
    reach, _, piece = s.partition(":")
    return int(reach), piece


def times(a: dict, b: dict) -> dict:
    """Product of two sparse matrices: the sum of scores is their product, the greater one their sum."""
    out: dict[str, dict[str, float]] = {}
    for i, row in a.items():
        new: dict[str, float] = {}
        for k, x in row.items():
            for j, y in b.get(k, {}).items():
                if x + y > new.get(j, -np.inf):
                    new[j] = x + y
        if new:
            out[i] = new
    return out


def trace(start: str, matrices: list[dict], end: str | None) -> list[str]:
    """States at all edges of the best path from start to end (to the best end if None)."""
    best, back = {start: 0.0}, []
    for m in matrices:
        new: dict[str, float] = {}
        step: dict[str, str] = {}
        for k, x in best.items():
            for j, y in m.get(k, {}).items():
                if x + y > new.get(j, -np.inf):
                    new[j], step[j] = x + y, k
        best = new
        back.append(step)
    at = max(best, key=best.get) if end is None else end
    out = [at]
    for step in reversed(back):
        out.append(at := step[at])
    return out[::-1]


@lru_cache(maxsize=2)
def coder(model: str) -> Coder:
    return Coder(model)


def _digest(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8")).hexdigest()


_OUT = "ids array<int>, n_pieces long, score double, decoded_sha1 string"


def encode(docs: DataFrame, scratch: Scratch | None = None, model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids, n_pieces, score, decoded_sha1) of every row; decoded_sha1 is that of the text the ids decode to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    giant = F.char_length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = c.whole.encode(part.column("text").to_pylist())
                texts = c.whole.decode(ids) if ids else []
                flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                total = np.concatenate([[0.0], np.cumsum(c.scores[flat])])
                score = [float(c.scores[flat[a:b]].sum()) for a, b in zip(off[:-1], off[1:], strict=True)] if len(off) > 1 else total[:0]
                cols = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat)), pa.array(np.diff(off)), pa.array(score, pa.float64()), pa.array([_digest(t) for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_pieces", "score", "decoded_sha1"])

    out = docs.where(~giant).mapInArrow(whole, f"doc_id {kind}, {_OUT}")
    scratch = scratch or Scratch(docs.sparkSession)
    chunks = scratch.save(split(docs.where(giant), chunk), "spm_chunks")
    if not chunks.limit(1).count():
        return out
    states = edge_states(chunks, scratch, model, block)

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for r in batch.to_pylist():
                ids = c.path(r["from_state"], r["body"], r["right"], r["to_state"])
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "doc_id": batch.schema.field("doc_id").type and pa.array([r["doc_id"]], batch.schema.field("doc_id").type), "chunk_no": pa.array([r["chunk_no"]], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("ids").slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([float(c.scores[ids].sum())]), pa.array([_digest(c.whole.decode(ids.tolist()))])], names=["doc_id", "ids", "n_pieces", "score", "decoded_sha1"])

    pieces = chunks.join(states, ["row", "chunk_no"]).select("row", "doc_id", "chunk_no", "body", "right", "from_state", "to_state").mapInArrow(backtrace, f"row string, doc_id {kind}, chunk_no int, ids array<int>")
    whole_ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))), lambda x: x["ids"]))
    joined = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), whole_ids.alias("ids")).select("doc_id", "ids")
    return out.unionAll(joined.mapInArrow(finish, f"doc_id {kind}, {_OUT}"))


def split(docs: DataFrame, chunk: int) -> DataFrame:
    """(row, doc_id, chunk_no, n_chunks, left, body, right): normalised text in chunks, with the margins that a piece may reach into."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    margin = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        for batch in batches:
            for i in range(batch.num_rows):
                text = MARK + batch.column("text")[i].as_py().replace(" ", MARK)
                row, n = uuid4().hex, -(-len(text) // chunk)
                for k in range(n):
                    a, b = k * chunk, min((k + 1) * chunk, len(text))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), batch.column("doc_id").slice(i, 1), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([text[max(0, a - margin) : a]]), pa.array([text[a:b]]), pa.array([text[b : b + margin]])],
                        names=["row", "doc_id", "chunk_no", "n_chunks", "left", "body", "right"],
                    )

    return docs.mapInArrow(run, f"row string, doc_id {kind}, chunk_no int, n_chunks int, left string, body string, right string")


def edge_states(chunks: DataFrame, scratch: Scratch, model: str, block: int) -> DataFrame:
    """(row, chunk_no, from_state, to_state) of every chunk."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            for r in batch.to_pylist():
                m = c.matrix(r["left"], r["body"], r["right"], r["chunk_no"] == 0, r["chunk_no"] == r["n_chunks"] - 1)
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "chunk_no": pa.array([r["chunk_no"]], pa.int32()), "part": pa.array([r["chunk_no"] // block], pa.int32()), "m": [json.dumps(m)]})

    def rows(table: pa.Table, by: str) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: r[by])

    def multiply(table: pa.Table) -> pa.Table:
        found = rows(table, "chunk_no")
        m = json.loads(found[0]["m"])
        for r in found[1:]:
            m = times(m, json.loads(r["m"]))
        return pa.table({"row": [found[0]["row"]], "part": pa.array([found[0]["part"]], pa.int32()), "m": [json.dumps(m)]})

    def scan(table: pa.Table) -> pa.Table:
        found = rows(table, "part")
        s = trace("0:", [json.loads(r["m"]) for r in found], None)
        return pa.table({"row": [r["row"] for r in found], "part": pa.array([r["part"] for r in found], pa.int32()), "start": s[:-1], "end": s[1:]})

    def push(table: pa.Table) -> pa.Table:
        found = rows(table, "chunk_no")
        s = trace(found[0]["start"], [json.loads(r["m"]) for r in found], found[0]["end"])
        return pa.table({"row": [r["row"] for r in found], "chunk_no": pa.array([r["chunk_no"] for r in found], pa.int32()), "from_state": s[:-1], "to_state": s[1:]})

    matrices = scratch.save(chunks.mapInArrow(measure, "row string, chunk_no int, part int, m string"), "spm_matrices")
    products = matrices.groupBy("row", "part").applyInArrow(multiply, "row string, part int, m string")
    edges = products.groupBy("row").applyInArrow(scan, "row string, part int, start string, end string")
    return matrices.join(edges, ["row", "part"]).groupBy("row", "part").applyInArrow(push, "row string, chunk_no int, from_state string, to_state string")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            texts = [None if x is None else c.whole.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
