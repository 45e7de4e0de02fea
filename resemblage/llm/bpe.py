"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The pieces that the vocabulary's pattern cuts a text into are encoded by
themselves. In a piece, every prefix's encoding ends in one token only. The
tokens that end at a position are the suffix matches of an automaton over the
vocabulary; of them that one is right which merging could leave beside the last
token of the prefix before it: the pair is compatible if undoing its merges
finds no earlier merge across the boundary. Back-pointers then give the ids,
exactly those that merging in rank order gives.
"""

from __future__ import annotations

import base64
import re
import string
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, byte_texts, pick

#: The rank file of the production vocabulary; any other of the same format may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut before merging.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s").search


def read_vocabulary(path: str = VOCABULARY, spark: SparkSession | None = None) -> list[bytes]:
    """The tokens by rank. With a session the file may lie on any file system that Spark reads."""
    if spark is None:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    else:
        where = path if "://" in path or path.startswith("file:") else f"file:{path}"
        lines = bytes(spark.read.format("binaryFile").load(where).select("content").first()[0]).splitlines()
    ranks = dict((base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line))
    return sorted(ranks, key=ranks.get)


class Encoder:
    """Encodes and decodes with one vocabulary, whose ids are ranks of merges."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN, memory: int = 400_000):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pieces = regex.compile(pattern).findall
        self.left, self.right, self.pairs = list(range(len(tokens))), list(range(len(tokens))), {}
        self.compatible: dict[int, bool] = {}
        self.plain: set[int] = set()
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self._split(i, t)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if i in self.plain or len(t) == 1:
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.spaced = Memo(lambda w: self._word(w, " "), memory, 48)
        self.bare = Memo(lambda w: self._word(w, "") if w else b"", memory, 48)
        self.marks = Memo(self._piece, memory // 4)
        self.newline = self._piece("\n")
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _split(self, i: int, t: bytes) -> None:
        """The last merge that makes token ``i``: its halves' encodings are single and fit together."""
        for k in range(1, len(t)):
            a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
            if a is not None and b is not None and a < i and b < i and self._reachable(a) and self._reachable(b) and (a, b) not in self.pairs and self._fits(a, b):
                self.left[i], self.right[i], self.pairs[a, b] = a, b, i
                self.plain.add(i)
                return

    def _reachable(self, i: int) -> bool:
        return len(self.tokens[i]) == 1 or i in self.plain

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no merge across their boundary comes before theirs."""
        pairs, left, right = self.pairs, self.left, self.right
        limit = 1 << 60
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece, by the table of last tokens of its prefixes."""
        raw = piece.encode()
        whole = self.rank.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        known, last, before = self.compatible, [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (token, n) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue  # there is only one
            start = end - n
            if start:
                previous = last[start]
                if previous < 0:
                    continue
                pair = previous << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) > 600_000:
                        known.clear()
                    fits = known[pair] = self._fits(previous, token)
                if not fits:
                    continue
            last[end], before[end] = token, start
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at = before[at]
        out.reverse()
        return array("i", out).tobytes()

    def _word(self, word: str, space: str) -> bytes:
        """The ids of a word and the space before it, if any."""
        if word.isalpha():
            return self._piece(space + word)
        bare = word.rstrip(string.punctuation)
        if bare.isalpha():
            return (self.spaced if space else self.bare)[bare] + self.marks[word[len(bare) :]]
        return self._cut(space + word)

    def _cut(self, text: str) -> bytes:
        return b"".join([self.marks[p] if len(p) < 32 else self._piece(p) for p in self.pieces(text)])

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``text``, each as four bytes, the lowest first.

        Where no white space follows white space, the pattern cuts at each line
        end and before each space, so what lies between is encoded by itself and
        remembered.
        """
        if _SPACES(text):
            return self._cut(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.bare[head])
            out += map(self.spaced.__getitem__, rest)
            out.append(self.newline)
        return b"".join(out[:-1])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _encode(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids, counts, exact = [], [], []
                for raw, known in zip(byte_texts(part.column(1)), part.column(1).is_valid().to_pylist()):
                    if not known:
                        ids.append(None), counts.append(None), exact.append(None)
                        continue
                    found = np.frombuffer(encoder.encode_bytes(raw.decode()), np.int32)
                    ids.append(found)
                    counts.append(len(found))
                    exact.append(encoder.decode_bytes(found) == raw)
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.int64()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "token_ids", "n_tokens", "is_exact"])

    return run


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path, spark))  # as large as the vocabulary


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` -> ``(doc_id, token_ids, n_tokens, is_exact)`` for each row.

    ``is_exact`` tells that decoding the ids gives the text's very bytes back. A
    null text has nulls, an empty one no ids. Special tokens' strings in a text are
    ordinary text. Repeated rows give repeated results; an empty table gives no rows. Texts are read whole, in time linear in
    their length; other columns are ignored, whatever their names.
    """
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, token_ids array<int>, n_tokens long, is_exact boolean"
    return rows.mapInArrow(_encode(vocabulary, _shared(docs.sparkSession, vocabulary)), schema)


def token_count(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A function from a column of texts to a column of how many ids each has, null for null; for ``chat.format_chats``."""
    shared = _shared(spark, vocabulary)

    def counts(texts: pa.Array) -> pa.Array:
        encoder = _encoder(vocabulary, shared)
        return pa.array([None if t is None else len(encoder.encode_bytes(t)) // 4 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(counts, "long")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                usual = None if ids is None else [i for i in ids if i is not None and 0 <= i < len(tokens)]
                texts.append(None if usual is None else b"".join(map(tokens.__getitem__, usual)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, token_ids)`` -> ``(doc_id, text)``.

    Null ids give a null text. Ids that are null or not of the vocabulary stand
    for nothing; bytes that are no UTF-8 become the replacement character.
    """
    rows = pick(encoded, "doc_id", "token_ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decode(_shared(encoded.sparkSession, vocabulary)), f"doc_id {kind}, text string")
