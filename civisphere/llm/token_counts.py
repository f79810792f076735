"""Exact token counts of every prefix by dynamic programming.

A byte-level BPE encoding is the one sequence of tokens whose adjacent pairs
are all compatible, so the encoding of a prefix is fixed by its last token
and the encoding of what is before it. A table over the prefixes of a match
holds that last token and the count; each is found from shorter ones. A
document stores the count of every prefix, by characters, as packed steps
from one to the next. The count of any prefix and truncation to a budget, also
inside a match, are read from them without encoding the document again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from civisphere.llm.byte_bpe import Ranks
from civisphere.llm.common import bounded_batches

#: How ByteLevel splits text before its merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 400_000
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable
    bytes for themselves, the others numbered from 256 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Prefix tables of matches for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], special: list[str]):
        self.bpe = Ranks(ranks, whole=False)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.blank, self.parted = regex.compile(r"\s+"), regex.compile(r"\s\s+\S")
        #: Tokens and packed steps of matches, and of runs of white space with the match behind them.
        self.kept: dict[str | tuple, tuple[int, bytes]] = {}
        #: Longest token that ends with given three bytes.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > self.reach.get(b[-3:], 0):
                self.reach[b[-3:]] = len(b)

    def table(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of a match, from the empty one on."""
        ranks, fits, compatible = self.bpe.ranks, self.bpe.fits, self.bpe.compatible
        counts, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        reach = self.reach
        for end in range(1, len(data) + 1):
            for at in range(max(0, end - reach.get(data[max(0, end - 3) : end], 2)), end):
                if (t := ranks.get(data[at:end])) is None:
                    continue
                if at == 0:
                    break
                pair = (last[at], t)
                ok = fits.get(pair)
                if compatible(*pair) if ok is None else ok:
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            counts[end], last[end] = counts[at] + 1, t
        return counts

    def along(self, part: str) -> list[int]:
        """Token counts of all prefixes of a match by characters, from the empty one on."""
        counts = self.table(part.encode("utf-8", "surrogatepass"))
        if len(counts) == len(part) + 1:
            return counts
        at = accumulate((len(c.encode("utf-8", "surrogatepass")) for c in part), initial=0)
        return [counts[k] for k in at]

    def match(self, part: str) -> tuple[int, bytes]:
        """Tokens of one match of the pattern, and the packed steps of its prefixes.

        Prefixes of a contraction are no contractions, so they are matched anew.
        """
        if (got := self.kept.get(part)) is None:
            if part[0] == "'" and part[1:].isalpha():
                counts = [0, *(sum(self.match(p)[0] for p in self.pattern.findall(part[:k])) for k in range(1, len(part))), self.along(part)[-1]]
            else:
                counts = self.along(part)
            got = counts[-1], steps(counts)
            self.keep(part, got)
        return got

    def keep(self, key: str | tuple, value: tuple[int, bytes]) -> None:
        if len(self.kept) > KEPT:
            self.kept.clear()
        if sum(map(len, key)) <= 64:
            self.kept[key] = value

    def spaced(self, blank: tuple[str, ...], part: str) -> tuple[int, bytes]:
        """As ``match``, for matches of white space and the match behind them.

        White space at the end of a text is one match, but before other
        characters its last one is parted from the rest, so prefixes that end
        in white space are counted as one match from where it begins.
        """
        key = (*blank, part)
        if (got := self.kept.get(key)) is None:
            lead = 0 if self.blank.fullmatch(part) else len(part) - len(part.lstrip(" "))
            before = sum(self.match(p)[0] for p in blank)
            counts = self.along("".join(blank) + part[:lead]) + [before + n for n in self.along(part)[lead + 1 :]]
            if part[0] == "'" and part[1:].isalpha():
                for k in range(1, len(part)):
                    counts[k - len(part) - 1] = before + sum(self.match(p)[0] for p in self.pattern.findall(part[:k]))
            got = counts[-1], steps(counts)
            self.keep(key, got)
        return got

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of ordinary text and special tokens, in order."""
        if not self.special or not self.special.search(text):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
            at = m.end()
        return out + [(text[at:], False)] * (at < len(text))

    def ordinary(self, part: str) -> tuple[int, list[bytes]]:
        """Tokens and packed steps of a stretch without special tokens."""
        found = self.pattern.findall(part)
        got = list(map(self.kept.get, found))
        if None in got:
            match = self.match
            got = [match(p) if v is None else v for p, v in zip(found, got, strict=True)]
        if not self.parted.search(part):
            return sum(v[0] for v in got), [v[1] for v in got]
        total, out, blank = 0, [], []
        for p, v in zip(found, got, strict=True):
            if self.blank.fullmatch(p):
                blank.append(p)
                continue
            if blank:
                v = self.spaced(tuple(blank), p)
                blank = []
            total += v[0]
            out.append(v[1])
        if blank:  # at the end it is one match
            n, packed = self.match("".join(blank))
            total += n
            out.append(packed)
        return total, out

    def index(self, text: str | None) -> Prefixes:
        """The stored index of a text: the packed steps of its prefix counts."""
        total, out, last = 0, [], ""
        for part, special in self.split(text or ""):
            if special:
                # a part of a special token is ordinary text and can join what is before it
                counts = [total, *(total + self.joined(last, part[:k]) for k in range(1, len(part))), total + 1]
                out.append(steps(counts))
                total, last = total + 1, ""
            else:
                n, packed = self.ordinary(part)
                total, last = total + n, part
                out += packed
        return Prefixes(total, b"".join(out))

    def joined(self, before: str, start: str) -> int:
        """Tokens that the start of a special token adds to the stretch before it."""
        tail = self.pattern.findall(before)[-1:] if before else []
        old = sum(self.match(p)[0] for p in tail)
        return sum(self.index(t).total for t in ["".join(tail) + start]) - old

    def prefix(self, index: Prefixes, text: str, size: int) -> int:
        """Tokens of ``text[:size]``, from the index."""
        return int(index.counts[max(0, min(size, len(index.counts) - 1))])

    def truncate(self, index: Prefixes, text: str, budget: int) -> str:
        """The longest prefix of ``budget`` tokens or fewer."""
        fits = np.flatnonzero(index.counts <= budget)
        return text[: fits[-1]] if len(fits) else ""


def steps(counts: list[int]) -> bytes:
    """Differences of neighbours as unsigned variable-length numbers, 0, -1, 1, -2, ... as 0, 1, 2, 3."""
    moves = [b - a for a, b in pairwise(counts)]
    if not moves or -64 < min(moves) and max(moves) < 64:
        return bytes([2 * m if m >= 0 else -2 * m - 1 for m in moves])
    out = bytearray()
    for m in moves:
        v = 2 * m if m >= 0 else -2 * m - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


class Prefixes:
    """Token counts of all prefixes of a text, by characters, and the last of them."""

    def __init__(self, total: int, packed: bytes):
        self.total, self.packed = total, packed

    @property
    def counts(self) -> np.ndarray:
        """Counts from the empty prefix on."""
        if not hasattr(self, "_counts"):
            raw = np.frombuffer(self.packed, np.uint8).astype(np.int64)
            if len(raw) and raw.max() > 127:
                ends = np.flatnonzero(raw < 128)
                starts = np.concatenate([[0], ends[:-1] + 1])
                place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
                raw = np.add.reduceat((raw & 127) << (7 * place), starts)
            self._counts = np.concatenate([[0], np.cumsum(np.where(raw & 1, -(raw + 1) // 2, raw // 2))])
        return self._counts

    def pack(self) -> bytes:
        """The steps, deflated."""
        return zlib.compress(self.packed, 1)

    @classmethod
    def unpack(cls, data: bytes) -> Prefixes:
        out = cls(0, zlib.decompress(data))
        out.total = int(out.counts[-1])
        return out


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    """The counter of a tokenizer file (byte-level BPE in JSON); every worker
    reads its installed copy once."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    as_bytes = lambda token: bytes(letters[c] for c in token)
    vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    # merges in order of rank; single bytes come first
    ranks = {b: -1 - i for b, i in vocab.items() if len(b) == 1}
    for k, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        ranks[as_bytes(a) + as_bytes(b)] = k
    return Counter(ranks, sorted(added))


def count_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, prefix_index`` of every whole text.

    ``n_tokens`` is the last entry of the prefix table; ``prefix_index`` is the
    packed index (see ``Prefixes``). No begin, end or added special tokens; a
    special token's string within a text is that token. Null and empty texts
    have no token. Other columns are left out; repeated rows stay.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            sizes, counts, packed = [], [], []
            for text in batch.column(1).to_pylist():
                p = own.index(text)
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                counts.append(p.total)
                packed.append(p.pack())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(packed, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_index"])

    src = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, prefix_index binary")


def truncate_documents(docs: DataFrame, index: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """``doc_id, text``: each text cut to ``budget`` tokens, from its stored index.

    ``index`` has ``doc_id`` and ``prefix_index``; a document without one, or
    with a null text, is left out.
    """
    bounded_batches(docs.sparkSession)
    both = docs.select("doc_id", "text").join(index.select("doc_id", "prefix_index"), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            cut = [own.truncate(Prefixes.unpack(i), t, budget) for t, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])

    return both.mapInArrow(run, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, text string")
