"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
words and word beginnings; a document's score is the noisy-or of its
sentences, ``1 - prod(1 - p)``. The weights are trained from document labels
alone, and the sentence scores then locate what made a document toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.llm.common import bounded_batches

#: Documented bounds of the training sample: documents of each label, and
#: UTF-8 bytes of text in all. Smaller labelled sets are used whole.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 14_000_000
BITS = 20
#: Lengths of the word beginnings that stand beside a whole word.
HEADS = (4, 5, 6)
BIAS, EPOCHS, RATE, L1 = -9.0, 60, 1.0, 3.5e-4
#: Features that one step of the training works on.
PART = 1 << 20
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[^.!?\n\r…。！？]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; white space alone is none."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m[0].isspace()]


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    names = ["w" + word, *(f"{n}{word[:n]}" for n in HEADS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for x in names]


@dataclass
class NoisyOr:
    """Trained weights. ``weights`` has 2**BITS entries, whatever the corpus."""

    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        if (v := self.known.get(word)) is None:
            if len(self.known) > 400_000:
                self.known.clear()
            v = self.known[word] = float(self.weights[features(word)].sum())
        return v

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score and the sentences as (start, end, score)."""
        rest, out, text = 0.0, [], text or ""
        known, word = self.known, self.word
        for a, b in sentences(text):
            z = self.bias
            for w in set(_WORD.findall(text[a:b].lower())):
                v = known.get(w)
                z += word(w) if v is None else v
            p = 1 / (1 + np.exp(-z)) if -500 < z < 500 else float(z > 0)
            rest += np.log1p(-min(p, 1 - 1e-12))
            out.append((a, b, float(p)))
        return float(-np.expm1(rest)), out


def bag(text: str | None, cache: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a document, sentence after sentence, and how many each sentence has."""
    cols, sizes, text = [], [], text or ""
    for a, b in sentences(text):
        n = len(cols)
        for w in sorted(set(_WORD.findall(text[a:b].lower()))):
            if w not in cache:
                cache[w] = features(w)
            cols.extend(cache[w])
        sizes.append(len(cols) - n)
    return np.asarray(cols, np.int32), np.asarray(sizes, np.int32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> NoisyOr:
    """Fit by adaptive gradient steps with soft thresholding (L1) on the
    noisy-or likelihood of ``bag`` of each document; both labels count alike.
    With one label missing the weights stay zero.

    Memory is twelve bytes for each feature of a sentence; what is larger is
    worked on in parts of ``PART`` features.
    """
    y = np.asarray(labels, bool)
    weights = np.zeros(1 << BITS, np.float32)
    if not y.any() or y.all():
        return NoisyOr(weights, BIAS)
    seen = np.zeros(1 << BITS, np.int32)
    for cols, _ in bags:
        seen[np.unique(cols)] += 1
    # a feature of one document alone says nothing about others
    used = np.flatnonzero(seen > 1)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.concatenate([s for _, s in bags])
    doc_of = np.repeat(np.arange(len(bags), dtype=np.int32), [len(s) for _, s in bags])
    idx = np.concatenate([place[c] for c, _ in bags])
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[idx >= 0]
    idx = idx[idx >= 0]
    parts = [slice(k, k + PART) for k in range(0, len(idx), PART)]
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    v, speed = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(EPOCHS):
        z = np.full(len(sizes), BIAS)
        for k in parts:
            z += np.bincount(row[k], v[idx[k]], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        # d log-likelihood / dz: label 1 gives p (1 - q) / q to each sentence, label 0 takes p
        g = p * (np.where(y, (1 - q) / q, -1.0) * share)[doc_of]
        grad = np.zeros(len(used))
        for k in parts:
            grad += np.bincount(idx[k], g[row[k]], len(used))
        speed += grad * grad
        eta = RATE / np.sqrt(speed)
        v = v + eta * grad
        v = np.sign(v) * np.maximum(np.abs(v) - eta * L1, 0)
    weights[used] = v
    return NoisyOr(weights, BIAS)


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """Train on at most about ``max_docs`` documents of each label and
    ``max_bytes`` of text, chosen by a hash of the id.

    Labels of a repeated id count as their maximum; null ids and labels are
    left out. Only ids of the sample, whose number is bounded, are broadcast.
    Features are made where the texts are; the driver gets 32-bit numbers.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(learnable(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    if not counts:
        return train([], [])
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)

    def sample(scale: float) -> DataFrame:
        share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, scale * max_docs / n)))))
        ids = known.where(F.col("y").isin(list(counts)) & (part < share[F.col("y")]))
        texts = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text"))
        return texts.join(F.broadcast(ids), "id").select("text", "y")

    size = sample(1.0).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounded_batches(docs.sparkSession)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            both = [bag(text, cache) for text in batch.column(0).to_pylist()]
            key = [zlib.crc32(c.tobytes()) for c, _ in both]
            packed = [pa.array([x[k].tobytes() for x in both], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(key, pa.int64()), *packed], ["y", "key", "cols", "sizes"])

    made = sample(min(1.0, max_bytes / max(size, 1))).mapInArrow(bags, "y int, key long, cols binary, sizes binary")
    # in one order, whatever the partitions
    rows = sorted(made.collect(), key=lambda r: (r["y"], r["key"], r["cols"]))
    return train([(np.frombuffer(r["cols"], np.int32), np.frombuffer(r["sizes"], np.int32)) for r in rows], [r["y"] for r in rows])


def score_documents(docs: DataFrame, model: NoisyOr, keep: bool = False) -> DataFrame:
    """Score every whole text.

    Returns the document's columns (``keep``) or its ``doc_id``, with
    ``score``, ``n_sentences`` and ``offending``: the sentences whose own score
    reaches 0.5, as (start, end, score) in code points, worst first. A null or empty
    text has no sentence and the score 0. Columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    made = ["score", "n_sentences", "offending"]
    df = docs.drop(*made) if keep else docs.select("doc_id", "text")
    names = df.columns
    at, out = names.index("text"), [n for n in names if keep or n != "text"]
    spans = "array<struct<start:int,end:int,score:double>>"
    schema = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in out), f"score double, n_sentences int, offending {spans}"])
    weights, bias = model.weights, model.bias
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB, whatever the corpus
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOr(shared.value, bias)
        for batch in batches:
            scores, counts, found = [], [], []
            for text in batch.column(at).to_pylist():
                p, each = own.score(text)
                scores.append(p)
                counts.append(len(each))
                found.append([dict(zip(("start", "end", "score"), s, strict=True)) for s in sorted(each, key=lambda s: (-s[2], s[0])) if s[2] >= 0.5])
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in out), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, kind)], [*out, *made])

    return df.mapInArrow(run, schema)
