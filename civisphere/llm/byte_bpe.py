"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves. An element of the monoid is a text with its
match boundaries under the split pattern and the token ids of each match;
two elements are joined by re-encoding a window around their seam that grows
until the boundaries outside of it provably stand. Inside one long match the
same is done on bytes: halves are encoded on their own, and the window at the
seam grows until its outermost tokens are compatible with their neighbours,
which by the pairwise theorem of BPE makes the whole sequence the encoding.
Decoding concatenates bytes up a tree.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from civisphere.llm.common import bounded_batches

#: Bytes of a match, and characters of a text, that are encoded without halving.
LEAF_BYTES, LEAF_CHARS = 24, 16_384
#: Bytes that are merged by looking at all pairs in every step.
SHORT = 48
#: Ids that are decoded at once.
LEAF_IDS = 65_536
#: Matches kept with their ids, and token pairs with their verdict, per worker.
KEPT = 400_000
#: Characters that the longest contraction of the pattern looks at.
LOOK = 3


class Ranks:
    """Merge ranks with the encodings of matches met so far."""

    def __init__(self, ranks: dict[bytes, int], whole: bool = True):
        self.ranks = ranks
        #: A match that is a token itself is that token (tiktoken's rule).
        self.whole = whole
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: Longest token that begins with given three bytes.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > self.reach.get(b[:3], 0):
                self.reach[b[:3]] = len(b)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        #: Bytes of all tokens in a row, and where each of them begins and how long it is.
        names = sorted(self.bytes_of) if min(self.bytes_of, default=0) >= 0 else []
        self.row = np.frombuffer(b"".join(self.bytes_of[i] for i in names), np.uint8)
        self.size, self.begin = np.zeros((2, max(names, default=-1) + 1), np.int64)
        self.size[names] = [len(self.bytes_of[i]) for i in names]
        self.begin[names] = np.cumsum(self.size[names]) - self.size[names]

    def merge(self, data: bytes) -> list[int]:
        """Encode by merging the pair of least rank, leftmost first."""
        if len(data) > SHORT:
            return self.merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """As ``merge``, with a heap of pairs and links between parts: n log n steps."""
        ranks, n = self.ranks, len(data)
        # of the part that begins at i: where it ends (0: merged into another), and the start of the one before
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            # a pair still stands if two parts in a row cover its bytes
            if not (j := end[i]) or j >= stop or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heappush(heap, (r, k, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b in a row are what their bytes encode to."""
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) > 4 * KEPT:
                self.fits.clear()
            ok = self.fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def leaf(self, data: bytes) -> list[int]:
        """Encode a short match without merging it: the longest tokens whose
        adjacent pairs are compatible. A prefix has one encoding, so a place
        that led nowhere is never entered again."""
        ranks, fits, n = self.ranks, self.fits, len(data)
        ids, sizes, dead = [], [], set()
        reach = self.reach
        at, size = 0, min(n, reach.get(data[:3], 2))
        while at < n:
            while size:
                t = ranks.get(data[at : at + size])
                if t is not None and at + size not in dead:
                    if not ids:
                        break
                    if (ok := fits.get((ids[-1], t))) is None:
                        ok = self.compatible(ids[-1], t)
                    if ok:
                        break
                size -= 1
            if size:
                ids.append(t)
                sizes.append(size)
                at += size
                size = min(n - at, reach.get(data[at : at + 3], 2))
            elif ids:
                dead.add(at)
                ids.pop()
                back = sizes.pop()
                at -= back
                size = back - 1
            else:
                return self.merge(data)
        return ids

    def halves(self, data: bytes, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """Encode a match of any length by halves.

        The first half has a power of two of bytes, so tokens of a run of one
        character meet at its seam; ``known`` holds equal halves of a match.
        """
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        known = {} if known is None else known
        if (ids := known.get(data)) is None:
            mid = 1 << (len(data) - 1).bit_length() - 1
            ids = self.join(self.halves(data[:mid], known), self.halves(data[mid:], known))
            if len(known) > 4096:
                known.clear()
            known[data] = ids
        return ids

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of the bytes of a then b.

        The window takes more tokens on a side while its outermost token there
        does not fit the one outside. If all adjacent pairs of a sequence are
        compatible, it is the encoding of its bytes, so the first window that
        fits on both sides ends the search; at last the window is all.
        """
        left, right = min(2, len(a)), min(2, len(b))
        while True:
            inside = self.merge(b"".join(self.bytes_of[i] for i in (*a[len(a) - left :], *b[:right])))
            fits_left = left == len(a) or self.compatible(a[len(a) - left - 1], inside[0])
            fits_right = right == len(b) or self.compatible(inside[-1], b[right])
            if fits_left and fits_right:
                return [*a[: len(a) - left], *inside, *b[right:]]
            left = left if fits_left else min(len(a), 2 * left)
            right = right if fits_right else min(len(b), 2 * right)

    def match(self, part: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        if (ids := self.kept.get(part)) is None:
            data = part.encode("utf-8", "surrogatepass")
            ids = (self.ranks[data],) if self.whole and data in self.ranks else tuple(self.halves(data))
            if len(self.kept) > KEPT:
                self.kept.clear()
            if len(part) <= 64:
                self.kept[part] = ids
        return ids


class Encoded(NamedTuple):
    """Text, where its matches begin, and their ids."""

    text: str
    starts: list[int]
    ids: list[tuple[int, ...]]


class Encoder:
    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)

    def matches(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        """Matches of a text in one piece and their ids."""
        parts = self.pattern.findall(text)
        ids = list(map(self.ranks.kept.get, parts))
        if None in ids:
            match = self.ranks.match
            ids = [match(p) if v is None else v for p, v in zip(parts, ids, strict=True)]
        return parts, ids

    def leaf(self, text: str) -> Encoded:
        parts, ids = self.matches(text)
        starts = list(accumulate(map(len, parts), initial=0))
        starts.pop()
        return Encoded(text, starts, ids)

    def settled(self, e: Encoded) -> int:
        """How many matches of ``e`` stand whatever text follows it.

        A match is decided by characters up to the first one after its run,
        and by ``LOOK`` from its start. All but white space at the end, the
        match before it and those that begin within ``LOOK`` stand.
        """
        space = len(e.text.rstrip())
        return max(0, min(bisect_left(e.starts, space), bisect_left(e.starts, len(e.text) - LOOK)) - 1)

    def combine(self, a: Encoded, b: Encoded) -> Encoded:
        """Encoding of a's text followed by b's."""
        if not a.text or not b.text:
            return b if not a.text else a
        keep = self.settled(a)
        cut = a.starts[keep] if keep < len(a.starts) else len(a.text)
        tail, n, size = a.text[cut:], len(a.text), 64
        while True:
            window = tail + b.text[:size]
            w = self.leaf(window)
            whole = size >= len(b.text)
            sure = len(w.starts) if whole else self.settled(w)
            # the first settled boundary of the window that is one of b's own: from there on
            # both scans read the same characters from the same place
            for k in range(bisect_left(w.starts, len(tail)), sure if not whole else len(w.starts)):
                at = w.starts[k] - len(tail)
                j = bisect_left(b.starts, at)
                if j < len(b.starts) and b.starts[j] == at:
                    starts = [*a.starts[:keep], *[cut + s for s in w.starts[:k]], *[n + s for s in b.starts[j:]]]
                    return Encoded(a.text + b.text, starts, [*a.ids[:keep], *w.ids[:k], *b.ids[j:]])
            if whole:
                return Encoded(a.text + b.text, [*a.starts[:keep], *[cut + s for s in w.starts]], [*a.ids[:keep], *w.ids])
            size *= 2

    def tree(self, text: str) -> Encoded:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        mid = len(text) // 2
        return self.combine(self.tree(text[:mid]), self.tree(text[mid:]))

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; null and empty texts have none."""
        text = text or ""
        # a text of one leaf has no seam
        ids = self.matches(text)[1] if len(text) <= LEAF_CHARS else self.tree(text).ids
        return list(chain.from_iterable(ids))

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of the ids, joined up a tree; a leaf is gathered at once."""
        if len(ids) <= LEAF_IDS:
            ids, r = np.asarray(ids, np.int64), self.ranks
            n = r.size[ids]
            ends = np.cumsum(n)
            return r.row[np.repeat(r.begin[ids] - ends + n, n) + np.arange(n.sum())].tobytes()
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


@lru_cache(2)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file; every worker reads its installed copy once."""
    with open(vocabulary, "rb") as f:
        return Encoder(Ranks(read_ranks(f.read())), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)``: token ids of every whole text.

    ``vocabulary`` is the path of a .tiktoken file that all machines have
    installed. Special tokens are ordinary text. Null and empty texts give an
    empty array. Other columns are left out; repeated rows stay.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            ids = [np.array(own.encode(x), np.int32) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    src = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) to rows with ``ids``; null ids decode to nothing.
    A column ``decoded`` of the input is replaced."""
    bounded_batches(encoded.sparkSession)
    df = encoded.drop("decoded")
    names = df.columns
    at = names.index("ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            out = [own.decode(x.values.to_numpy() if x.is_valid else []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def digest_ids(ids: list[int]) -> str:
    """SHA-256 in lower-case hex of the decimal ids joined by commas."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
