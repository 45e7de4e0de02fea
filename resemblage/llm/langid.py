"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte n-grams of 2 to 4 within words (lower case; all
that is no word byte counts as one gap). Each n-gram has an embedding, found by
hashing; their mean goes through a linear layer and a softmax. Embeddings and
layer are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. A temperature, fitted on held-out rows, calibrates the
probabilities, and the threshold for rejection is set on the same rows: the least at which so few of the accepted
are wrong as is wanted. Copies of a text are held out together, or not at all.

As the layer is linear, the mean of embeddings times the layer is the mean of
the embeddings' products: at use one table of a row for each bucket suffices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import DOCUMENT_COLUMNS, byte_texts, pick, slices
from .words import _IN_WORD, lowered

#: Rows that the model is fitted on, at most, for each language. All rows are classified.
SAMPLE = 400
BUCKETS, DIMENSIONS, EPOCHS, RATE, SEED = 1 << 16, 16, 5, 0.2, 11
HELD_OUT = 0.3
#: Of the held-out rows that are accepted so many may be wrong, and an accepted language is more probable than all others together; but no more of them than this are rejected.
ERROR, REJECTED, SURE = 0.05, 0.05, 0.5
_GAP = 32
_FOLD = np.where(_IN_WORD == 1, np.arange(256), _GAP).astype(np.uint8)
_SHIFT = np.uint32(16)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts``, and the text that each belongs to."""
    low = [lowered(t) for t in texts]
    raw = np.frombuffer(b"\n".join([b"", *low, b""]) + b"\n\n\n", np.uint8)
    starts = np.cumsum([1, *(len(t) + 1 for t in low)])
    b = _FOLD[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != _GAP) | (b[:-1] != _GAP)  # one gap between words
    at = np.flatnonzero(keep)
    b, starts = np.concatenate([b[at], [_GAP] * 3]).astype(np.uint32), np.searchsorted(at, starts)
    gap = b == _GAP
    n = len(b) - 3
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = b[:n] * np.uint32(256) + b[1 : n + 1]
    three = two * np.uint32(256) + b[2 : n + 2]
    four = three * np.uint32(256) + b[3 : n + 3]
    inner = gap[1 : n + 1]
    wide = inner | gap[2 : n + 2]
    ok2 = ~(gap[:n] & inner)
    ok3, ok4 = ok2 & ~inner, ok2 & ~wide
    owner = np.searchsorted(starts, np.arange(n) + gap[:n], side="right") - 1  # a gap is that before what follows
    owner = np.clip(owner, 0, len(texts) - 1)
    grams = [two[ok2], ((three[ok3] * np.uint32(0x9E3779B1)) >> _SHIFT), (((four[ok4] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> _SHIFT)]
    return np.concatenate(grams).astype(np.int64), np.concatenate([owner[ok2], owner[ok3], owner[ok4]])


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and how large a share each has."""
    out = []
    for t in texts:
        h, _ = subwords([t])
        u, c = np.unique(h, return_counts=True)
        out.append((u, (c / max(1, c.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of logits for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row of probabilities for each text, and which texts have n-grams at all."""
        logits, seen = np.zeros((len(texts), len(self.languages)), np.float64), np.zeros(len(texts), np.int64)
        h, owner = subwords(texts)
        if len(h):
            seen = np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                logits[:, k] = np.bincount(owner, self.table[h, k], len(texts))
        return _softmax((logits / np.maximum(seen, 1)[:, None] + self.bias) / self.temperature), seen > 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _snippet(text: bytes, rng: np.random.Generator) -> bytes:
    words = text.split()
    n = int(rng.integers(1, 13))
    a = int(rng.integers(0, max(1, len(words) - n)))
    return b" ".join(words[a : a + n])


def step(e: np.ndarray, w: np.ndarray, bias: np.ndarray, h: np.ndarray, share: np.ndarray, label: int, weight: np.float32, rate: np.float32) -> None:
    """One step of gradient descent on the loss of a text that has ``share`` of each of the buckets ``h``."""
    hidden = share @ e[h]
    p = _softmax(hidden @ w + bias)
    p[label] -= 1
    p *= weight
    back = w @ p
    w -= rate * np.outer(hidden, p)
    bias -= rate * np.float32(0.1) * p
    e[h] -= rate * np.outer(share / (share @ share), back)  # the mean moves by rate * back, however long the text


def threshold(confidence: np.ndarray, right: np.ndarray, error: float = ERROR, rejected: float = REJECTED, sure: float = SURE) -> float:
    """The least confidence, ``sure`` or more, at which of the rows that have it or more ``error`` at most are wrong; less if more than ``rejected`` of the rows would be below."""
    order = np.argsort(confidence)
    wrong = np.cumsum(~right[order][::-1])[::-1] / np.arange(len(order), 0, -1)  # of a row and those above it
    few = np.flatnonzero(wrong <= error)
    wanted = confidence[order[few[0]]] if len(few) and few[0] else 0.0 if len(few) else 1.0
    return float(min(max(sure, wanted), confidence[order[int(rejected * len(order))]]))


def fit(rows: list[tuple[bytes, str]], seed: int = SEED) -> Model | None:
    """Fit on ``(text, language)`` rows; None if there are none. Each row also gives a snippet, as texts may be short."""
    rows = sorted((t, x) for t, x in rows if t and x is not None)
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({x for _, x in rows})
    held = {i for i, (t, _) in enumerate(rows) if xxhash.xxh3_64_intdigest(t, seed) % 1000 < 1000 * HELD_OUT} if len(rows) >= 10 else set()
    held = held if len(held) < len(rows) else set()
    label = {x: i for i, x in enumerate(languages)}
    examples = {False: ([], []), True: ([], [])}
    for i, (text, x) in enumerate(rows):
        for t in (text, _snippet(text, rng)):
            examples[i in held][0].append(t)
            examples[i in held][1].append(label[x])
    train, y = bags(examples[False][0]), np.array(examples[False][1])
    counts = np.bincount(y, minlength=len(languages))
    weight = counts.sum() / np.maximum(counts, 1) / len(languages)
    e = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            h, share = train[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(h):
                continue
            step(e, w, bias, h, share, y[i], np.float32(min(weight[y[i]], 10.0)), rate)
    model = Model(languages, e @ w, bias.astype(np.float64))
    if held:
        texts, y = examples[True][0], np.array(examples[True][1])
        p, known = model.probabilities(texts)
        z, y = np.log(np.maximum(p[known], 1e-30)), y[known]
        if len(y):
            grid = np.geomspace(0.05, 20, 121)
            model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()))
            best = _softmax(z / model.temperature).max(axis=1)
            p = _softmax(z / model.temperature)
            model.threshold = threshold(p.max(axis=1), p.argmax(axis=1) == y)
    return model


def sample(docs: DataFrame, most: int = SAMPLE) -> list[tuple[bytes, str]]:
    """At most ``most`` labelled rows of each language: those whose ids hash lowest."""
    rows = pick(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return []
    turn = (F.xxhash64("doc_id", F.lit(SEED)) / F.lit(2.0**64)) + 0.5
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * most / r["count"] + 20.0 / r["count"])))])
    few = rows.withColumn("turn", turn).filter(F.col("turn") <= share[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("turn", F.xxhash64("text")))
    return [(r["text"].encode(), r["lang"]) for r in few.withColumn("nth", nth).filter(F.col("nth") <= most).select("text", "lang").collect()]


def train(docs: DataFrame, most: int = SAMPLE) -> Model | None:
    return fit(sample(docs, most))


def _classify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = byte_texts(batch.column(batch.schema.get_field_index("text")))
            best, sure, rejected = [], [], []
            for a, b in slices([len(t) for t in texts], 1_000_000):
                if model is None:
                    best, sure, rejected = best + [None] * (b - a), sure + [None] * (b - a), rejected + [False] * (b - a)
                    continue
                p, known = model.probabilities(texts[a:b])
                top = p.max(axis=1)
                best += [model.languages[i] if k else None for i, k in zip(p.argmax(axis=1), known)]
                sure += [round(float(x), 6) if k else None for x, k in zip(top, known)]
                rejected += (~known | (top < model.threshold)).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, "language", "confidence", "is_rejected"],
            )

    return run


def _judged(docs: DataFrame, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is BUCKETS times the number of languages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_classify(shared), f"{fields}, language string, confidence double, is_rejected boolean")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``documents`` -> ``(doc_id, language, confidence, is_rejected)`` for each row.

    Without a model one is trained on the rows' own ``lang``. Texts that are null,
    empty or have no word bytes get null and are rejected, as are texts whose best
    language is less probable than the threshold. Where no row is labelled nothing
    can be learnt: all get null and none is rejected. Repeated rows are judged alike. Texts are read whole, however long; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = train(docs) if model is None else model
    rows = _judged(pick(docs, "doc_id", "text"), model)
    return rows.select("doc_id", "language", "confidence", "is_rejected")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with its five columns; ``lang`` becomes the language found.

    Rows that repeat are kept or rejected alike. Null, empty and wordless texts are rejected, unless no row is labelled: then all
    stay as they are. Nulls of other columns stay; an empty table gives no rows; further columns are left out.
    """
    model = train(docs) if model is None else model
    rows = _judged(pick(docs, *DOCUMENT_COLUMNS), model).filter("not is_rejected")
    return rows.withColumn("lang", F.coalesce("language", "lang")).select(*DOCUMENT_COLUMNS)
