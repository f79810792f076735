"""Language identification with word-first backoff.

A word the model knows adds its log frequency in each language. An unseen
word is scored by the longest character n-grams of it that are known, from
``MAX_GRAM`` down to single characters. Word boundaries are part of n-grams.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.llm.common import bounded_batches

#: Documented bound: UTF-8 bytes of text that are learnt from, shared between the
#: languages. All words and n-grams of that sample are kept, which bounds the model.
SAMPLE_BYTES = 32_000_000
MAX_GRAM = 5
#: A word unknown to one language but known to another counts as this often.
UNSEEN = 0.1
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # the pattern also takes numbers such as ½, ² or Ⅷ, which are no letters
    parted = ("".join(c if c.isalpha() else " " for c in w) for w in found)
    return [w for part in parted for w in part.split()]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies per language of all words and n-grams of the sample.

    ``counts`` maps a kind ("w" for words, else the size of an n-gram) to its
    names and a table of counts, a row for each name and a column for each language.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[list[str], np.ndarray]]):
        self.langs = langs
        n = len(langs)
        logs = {k: np.log((c + UNSEEN) / (c.sum(axis=0) + 1)).astype(np.float32) for k, (_, c) in counts.items()}
        sizes = [k for k in counts if k != "w"]
        self.rows = logs.get("w", np.zeros((0, n), np.float32))
        self.known = {w: k for k, w in enumerate(counts["w"][0])} if "w" in counts else {}
        self.parts = {g: i for i, g in enumerate(g for k in sizes for g in counts[k][0])}
        self.part_rows = np.concatenate([np.zeros((0, n), np.float32), *(logs[k] for k in sizes)])
        self.fresh: dict[str, int] = {}
        self.table = np.concatenate([self.rows, np.zeros((1, n), np.float32)])
        self.used = len(self.table)

    def backoff(self, word: str) -> np.ndarray:
        """Mean over the known n-grams of the largest size that has one; zeros if none has."""
        for n in range(MAX_GRAM, 0, -1):
            if found := [p for g in grams(word, n) if (p := self.parts.get(g)) is not None]:
                return self.part_rows[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        """Row of an unseen word; its scores are kept for a while."""
        if (k := self.fresh.get(word)) is None:
            if self.used == len(self.table):
                if len(self.table) > len(self.rows) + 200_000:
                    return -1
                self.table = np.concatenate([self.table, np.zeros((len(self.table) // 2 + 64, len(self.langs)), np.float32)])
            k = self.fresh[word] = self.used
            self.table[k] = self.backoff(word)
            self.used += 1
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the posterior. Ties go to the first name."""
        found = words(text)
        if not found or not self.langs:
            return UNDETERMINED, 0.0
        known, fresh, rows, extra = self.known, self.fresh, [], 0.0
        for w in found:
            if (k := known.get(w)) is None and (k := fresh.get(w)) is None and (k := self.row(w)) < 0:
                extra = extra + self.backoff(w)
                continue
            rows.append(k)
        total = self.table[rows].sum(axis=0, dtype=float) + extra
        if self.used > len(self.rows) + 150_000:  # between documents only: rows are in use above
            self.fresh.clear()
            self.used = len(self.rows) + 1
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def learnable(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(docs: DataFrame, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn word and n-gram frequencies.

    The sample takes about ``max_bytes`` of text: each language its equal part
    or all it has, chosen by a hash of the id. Words and n-grams are counted
    where the texts are; the driver gets the counts. Rows without
    lang or text teach nothing.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select("doc_id", docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where("lang is not null and text is not null").where(learnable(F.col("doc_id")))
    sizes = {r["lang"]: r["b"] or 0 for r in own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_bytes / len(langs) / max(1, sizes[k]))))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = own.where(part < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict) -> pa.RecordBatch:
            rows = [(lang, kind, g, n) for (lang, kind), c in held.items() for g, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "gram", "n"])

        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = Counter(words(text))
                held[lang, "w"].update(seen)
                for w, k in seen.items():
                    for n in range(1, MAX_GRAM + 1):
                        c = held[lang, str(n)]
                        for g in grams(w, n):
                            c[g] += k
            if sum(map(len, held.values())) > 300_000:
                yield out(held)
                held.clear()
        if held:
            yield out(held)

    counted = sample.mapInArrow(count, "lang string, kind string, gram string, n long").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("kind", "gram").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"l{i}") for i, k in enumerate(langs)))
    named = [f"l{i}" for i in range(len(langs))]
    got = wide.select("kind", "gram", *named).toArrow()
    counts = {}
    for kind in sorted(set(got["kind"].unique().to_pylist())):
        own = got.filter(pc.equal(got["kind"], kind))
        counts[kind] = own["gram"].to_pylist(), np.stack([own[c].to_numpy() for c in named], axis=1).astype(float)
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """Predict the language of every whole text.

    Returns the document's columns (``keep``) or its ``doc_id``, with
    ``lang_pred`` and ``score`` (posterior share). A null text or one without
    a letter is ``und`` with the score 0, and so is every text if nothing was
    learnt. Columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    df = docs.drop("lang_pred", "score") if keep else docs.select("doc_id", "text")
    names = df.columns
    at, out = names.index("text"), [n for n in names if keep or n != "text"]
    schema = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in out), "lang_pred string, score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            both = [own.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in out), pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.float64())], [*out, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
