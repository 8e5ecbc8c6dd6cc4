"""Alignment of the tokens of two tokenizers over one text: a dangling-suffix transducer.

The state is which side leads and which of its bytes the other side has not matched yet. The lagging side's
next token shortens these bytes or takes over the lead with what is left of it; either way the token
overlaps the leader's last one, which is a link. Empty bytes close a group. Transitions are kept by
state and token.

Tokens of either tokenizer end at a single space between two characters that are no white space, so a text
is cut there into pieces; the transducer runs once over each different piece (a bounded cache holds the last
ones) and a text's numbers are put together from its pieces'. Pieces that a task meets first go to the
tokenizers joined, a batch at a time; a text whose tokens don't give its bytes is taken whole.

1. One pass over the documents writes, for each, its numbers, the digest of its groups and its links as
   sorted arrays of id pairs with their multiplicity; a second, narrow read of the arrays counts in how many documents
   each pair is linked: summed in each task first, then by pair.
2. The counts, at most one for each pair of ids of the two vocabularies whatever the corpus, are cut into
   slices of at most ``SLICE_PAIRS``. One slice after another is broadcast (its size is bounded by that) to the
   written documents, which add what their links find in it; no link is sent through a shuffle.

Defined results: null and empty texts, and texts whose joined bytes on either side differ from a space and the
text, have no tokens: zeros and an empty digest; null and repeated ids and repeated rows are documents
each; very long texts are taken whole; ties for the highest count all are best; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import slices, written

#: Pieces in each of the two generations of the cache, pairs counted in a task before they go out, and pairs in a broadcast.
CACHE_PIECES = 250_000
TASK_PAIRS = 2_000_000
SLICE_PAIRS = 4_000_000
_SHIFT = 32
#: Fixed value: how byte-level BPE files of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EDGES = re.compile(r"\s\s|^\s|\s\Z")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def load_byte_bpe(path: str):
    """(encode, bytes of every id) of a byte-level BPE file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text
    letters, vocabulary = byte_letters(), tokenizer.get_vocab(with_added_tokens=True)
    of = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return _by_ranks(path, letters) or (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), of


def _by_ranks(path: str, letters: dict[str, int]):
    """The same encoding by the faster library, where the file is plain: ids in the order of merges, the common split."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    plain = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not model.get("ignore_merges")
    if not plain or first != 256 or any(model["vocab"].get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load_pieces(path: str):
    """(encode, bytes of every id) of a sentencepiece file; encode takes the text without the space that it adds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE_PIECE.fullmatch(piece) if model.is_byte(i) else None
        of.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return model.encode, of


class Mismatch(ValueError):
    """The two sides' tokens do not spell the same bytes."""


class Transducer:
    """Groups and links of two token sequences over the same bytes.

    A state is a number: 0 where a group is closed, else which side leads (even: the first, odd: the second)
    and its unmatched bytes. ``steps`` keeps where a state and the lagging side's token lead to.
    """

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.of = (bytes_a, bytes_b)
        self.shown = tuple([str(i) for i in range(len(x))] for x in self.of)
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[int, int] = {}
        self.residuals: dict[int, bytes] = {0: b""}
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0, (1, b""): 0}
        self.starts: dict[int, int] = {}

    def state(self, leading: int, residual: bytes) -> int:
        found = self.states.get((leading, residual))
        if found is None:
            found = 2 * len(self.residuals) + leading
            self.states[leading, residual], self.residuals[found] = found, residual
        return found

    def start(self, token: int) -> int:
        """The state after a group's first token."""
        if not self.of[0][token]:
            raise Mismatch("a token without bytes")
        self.starts[token] = self.state(0, self.of[0][token])
        return self.starts[token]

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's next token."""
        leading, residual = state & 1, self.residuals[state]
        got = self.of[1 - leading][token]
        if residual.startswith(got) and got:
            after = self.state(leading, residual[len(got) :])
        elif got.startswith(residual):
            after = self.state(1 - leading, got[len(residual) :])
        else:
            raise Mismatch((residual, got))
        self.steps[state << 20 | token] = after
        return after

    def align(self, a: list[int], b: list[int], ends: list[tuple[int, int]]) -> list[tuple]:
        """For each part of the sequences, which end at ends: (n_a, n_b, n_groups, groups as text, links as bytes)."""
        if len(self.steps) > CACHE_PIECES:
            self._forget()
        steps, starts, (shown_a, shown_b) = self.steps, self.starts, self.shown
        out, i, j = [], 0, 0
        try:
            for end_a, end_b in ends:
                begun_a, begun_b, groups, links = i, j, [], []
                while i < end_a:
                    first_a, first_b, x = i, j, a[i]
                    i += 1
                    state = starts.get(x) or self.start(x)
                    while state:
                        if state & 1:
                            x = a[i]
                            i += 1
                            after = steps.get(state << 20 | x)
                            state = self.step(state, x) if after is None else after
                        else:
                            y = b[j]
                            j += 1
                            after = steps.get(state << 20 | y)
                            state = self.step(state, y) if after is None else after
                        links.append(x << _SHIFT | y)
                    groups.append(shown_a[x] + "|" + shown_b[y] if i - first_a == j - first_b == 1 else ",".join([shown_a[t] for t in a[first_a:i]]) + "|" + ",".join([shown_b[t] for t in b[first_b:j]]))
                if (i, j) != (end_a, end_b):
                    raise Mismatch("a group does not end with its part")
                out.append((i - begun_a, j - begun_b, len(groups), ";".join(groups), array("q", links).tobytes()))
        except IndexError:
            raise Mismatch("unmatched bytes at the end") from None
        return out


def cut(text: str) -> list[str]:
    """text in pieces: cut at single spaces between two characters that are no white space, which are left out.

    " " before each piece and all joined gives " " and text.
    """
    words = text.split(" ")
    if not _EDGES.search(text):
        return words
    out = [words[0]]
    for w in words[1:]:
        before = out[-1]
        if w and before and not w[0].isspace() and not before[-1].isspace():
            out.append(w)
        else:
            out[-1] = before + " " + w
    return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        (self.encode_a, bytes_a), (self.encode_b, bytes_b) = load_byte_bpe(path_a), load_pieces(path_b)
        self.transducer = Transducer(bytes_a, bytes_b)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def whole(self, text: str) -> tuple | None:
        """A text without cuts; None where a side does not give a space and the text."""
        a, b = self.encode_a(" " + text), self.encode_b(text)
        of_a, of_b = self.transducer.of
        want = (" " + text).encode()
        if b"".join(of_a[i] for i in a) != want or b"".join(of_b[i] for i in b) != want:
            return None
        return self.transducer.align(a, b, [(len(a), len(b))])[0]

    def _joined(self, pieces: list[str]) -> dict[str, tuple | None]:
        """The pieces tokenized as one text and cut at their ends; one by one where that does not work out."""
        text = " ".join(pieces)
        of_a, of_b = self.transducer.of
        a, b = self.encode_a(" " + text), self.encode_b(text)
        ends = np.cumsum([1 + len(p.encode()) for p in pieces])
        reach_a, reach_b = np.cumsum([len(of_a[i]) for i in a]), np.cumsum([len(of_b[i]) for i in b])
        at_a, at_b = np.searchsorted(reach_a, ends), np.searchsorted(reach_b, ends)
        fits = len(a) and len(b) and at_a[-1] == len(a) - 1 and at_b[-1] == len(b) - 1 and (reach_a[at_a] == ends).all() and (reach_b[at_b] == ends).all()
        want = (" " + text).encode()
        if not fits or b"".join(of_a[i] for i in a) != want or b"".join(of_b[i] for i in b) != want:
            if len(pieces) == 1:
                return {pieces[0]: self.whole(pieces[0])}
            half = len(pieces) // 2
            return self._joined(pieces[:half]) | self._joined(pieces[half:])
        parts = zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True)
        return dict(zip(pieces, self.transducer.align(a, b, list(parts)), strict=True))

    def learn(self, texts: list[list[str]]) -> dict[str, tuple | None]:
        """The pieces of the texts. Two generations are kept, so that the cache is bounded and frequent pieces stay."""
        seen: set[str] = set()
        for pieces in texts:
            seen.update(pieces)
        if len(self.young) + len(seen) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        fresh = []
        for p in seen.difference(self.young):
            if p in self.old:
                self.young[p] = self.old[p]
            else:
                fresh.append(p)
        fresh.sort()
        for at in range(0, len(fresh), 2_000):
            self.young.update(self._joined(fresh[at : at + 2_000]))
        return self.young

    def document(self, text: str, pieces: list[str], known: dict[str, tuple | None]) -> tuple[int, int, int, str, np.ndarray]:
        """n_a, n_b, n_groups, digest and links of a text; zeros where its bytes come out otherwise."""
        if not text:
            return _NOTHING
        found = [known[p] for p in pieces]
        if None in found:
            whole = self.whole(text)
            if whole is None:
                return _NOTHING
            found = [whole]
        n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return sum(n_a), sum(n_b), sum(n_groups), digest, np.frombuffer(b"".join(links), dtype=np.int64)


_NOTHING = (0, 0, 0, "", np.zeros(0, dtype=np.int64))
_open: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _open:
        _open[path_a, path_b] = Aligner(path_a, path_b)
    return _open[path_a, path_b]


ALIGNED = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its numbers, digest, and different links (pairs: sorted long, as gaps; times: unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = aligner(path_a, path_b)
        for part in slices(batches, 200):
            texts = [t or "" for t in part.column(1).to_pylist()]
            pieces = [cut(t) if t else [] for t in texts]
            known = mine.learn(pieces)
            got = [mine.document(t, p, known) for t, p in zip(texts, pieces, strict=True)]
            pairs, times = zip(*(np.unique(g[4], return_counts=True) for g in got), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)], pa.array([len(g[4]) for g in got], pa.int64()), pa.array([g[3] for g in got], pa.string()),
                    pa.array([np.diff(p, prepend=0).astype("<i8").tobytes() for p in pairs], pa.binary()), pa.array([t.astype("<u4").tobytes() for t in times], pa.binary()),
                ],
                names=[c.split()[0] for c in ALIGNED.split(", ")],
            )

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def _pairs(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, dtype="<i8"))


def link_counts(documents: DataFrame) -> DataFrame:
    """pair, documents: in how many documents each id pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, waiting, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def summed():
            both = np.concatenate([pair, *waiting])
            ones = np.concatenate([n, np.ones(sum(map(len, waiting)), dtype=np.int64)])
            order = np.argsort(both, kind="stable")
            both, ones = both[order], ones[order]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            return both[first], np.add.reduceat(ones, first) if len(first) else ones[:0]

        for batch in batches:
            waiting += [_pairs(x) for x in batch.column(0).to_pylist() if x]
            size = sum(map(len, waiting))
            if size > TASK_PAIRS:
                (pair, n), waiting = summed(), []
                if len(pair) > TASK_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "documents"])
                    pair, n = pair[:0], n[:0]
        pair, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "documents"])

    return documents.select("pairs").mapInArrow(count, "pair long, documents long").groupBy("pair").agg(F.sum("documents").alias("documents"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark = docs.sparkSession
    documents = written(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = link_counts(documents)
    a = F.shiftright("pair", _SHIFT)
    # an id of A has at most as many pairs as B has ids
    best = F.col("documents") == F.max("documents").over(Window.partitionBy(a))
    counts = written(counts.select("pair", "documents", best.alias("best")), "links")
    slices_ = max(1, -(-counts.count() // (slice_pairs // 2)))
    out = documents.select("id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256", "pairs", "times")
    for k in range(slices_):
        mine = counts if slices_ == 1 else counts.filter(F.pmod(F.xxhash64("pair"), F.lit(slices_)) == k)
        out = _with_slice(out, _sent(spark, mine))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c not in ("id", "pairs", "times")])


def _sent(spark, counts: DataFrame):
    """One slice of the counts as sorted arrays in a broadcast: its number of pairs is bounded."""
    table = counts.toArrow().sort_by("pair")
    return spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "documents", "best")))


def _with_slice(documents: DataFrame, sent) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            more_best, more = [], []
            for gaps, times in zip(batch.column(8).to_pylist(), batch.column(9).to_pylist(), strict=True):
                mine, often = _pairs(gaps), np.frombuffer(times, dtype="<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
                there = pair[at] == mine if len(pair) else np.zeros(len(mine), dtype=bool)
                at, often = at[there], often[there]
                more_best.append(int(often[best[at]].sum()))
                more.append(int((often * n[at]).sum()))
            columns = list(batch.columns)
            for k, extra in ((5, more_best), (6, more)):
                columns[k] = pa.array(np.array(columns[k].to_pylist(), dtype=np.int64) + np.array(extra, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(add, documents.schema)
