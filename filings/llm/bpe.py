"""Byte-pair encoding with the ranks of a public vocabulary.

Distinct pre-split pieces are held as symbol arrays. In each round the adjacent pairs of all pieces are joined with the
merge ranks, each piece takes its lowest-ranked pair (the first of equals) and pieces without a pair are done.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import regex

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP, MARGIN = 1 << 16, 512, 4  # characters; MARGIN: the longest part that a pre-token's end can hang on
LONG = 512  # bytes; longer pieces are merged by a heap, since a round merges one pair of a piece
KEPT = 1 << 20  # pieces whose ids a task keeps; beyond that it starts anew
_NONE = np.int32(2**31 - 1)


class Bpe:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.words = {i: w for w, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(a << 20) | b: i for w, i in self.ranks.items() for k in range(1, len(w)) if (a := self.ranks.get(w[:k])) is not None and (b := self.ranks.get(w[k:])) is not None}
        self.pair = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.kept: dict[str, list[int]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge join: the rank of each pair, or _NONE."""
        k = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        return np.where(self.pair[at] == k, self.into[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece of at most LONG bytes."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(sym), _NONE, np.int32)
        same = own[:-1] == own[1:]
        rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            for k in np.flatnonzero(done):
                out[own[starts[k]]] = sym[starts[k] : starts[k] + size[k]].tolist()
            at = np.flatnonzero(rank == np.repeat(np.where(done, -1, least), size))
            if not len(at):
                break
            at = at[np.r_[True, own[at][1:] != own[at][:-1]]]
            sym[at] = rank[at]
            keep = ~np.repeat(done, size)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, own, rank = sym[keep], own[keep], rank[keep]
            # Only the pairs beside a merged symbol are joined again.
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i] = np.where((own[i] == own[j]) & (i < j), self._rank(sym[i], sym[j]), _NONE)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for a piece of any length, by a heap of its pairs."""
        sym = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        w = self.words
        rank = lambda i: self.ranks.get(w[sym[i]] + w[sym[after[i]]]) if i >= 0 and after[i] >= 0 else None
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(len(sym) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, sym[k], sym[after[k]]))
        return [x for x in sym if x >= 0]

    def learn(self, split: list[list[str]]) -> None:
        """Encode the distinct pieces that aren't kept yet."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set().union(*split).difference(self.kept)
        rest = []
        for p in new:
            b = p.encode("utf-8", "surrogatepass")
            if (i := self.ranks.get(b)) is not None:
                self.kept[p] = [i]
            elif len(b) > LONG:
                self.kept[p] = self.merge_long(b)
            else:
                rest.append((p, b))
        if rest:
            for (p, _), ids in zip(rest, self.merge([b for _, b in rest])):
                self.kept[p] = ids

    def boundaries(self, chunk: str) -> list[int]:
        """Where the pre-tokens of a chunk begin."""
        return [m.start() for m in self.pattern.finditer(chunk)]

    def split(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pre-tokens of text, from overlapping chunks."""
        if len(text) <= chunk:
            return self.pattern.findall(text)
        bounds = [[a + x for x in self.boundaries(text[a : a + chunk + overlap])] for a in range(0, len(text), chunk)]
        at = [*self.stitch(text, bounds, chunk, overlap), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def stitch(self, text: str, bounds: list[list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[int]:
        """One sequence of the boundaries of overlapping chunks. A chunk's boundaries hold from the first that the text before also
        has; where the overlap has none, the text is split on from the last sure boundary until one is met."""
        sure = bounds[0]
        for k in range(1, len(bounds)):
            end = (k - 1) * chunk + chunk + overlap
            own = set(bounds[k])
            meet = next((b for b in sure if b in own and b < end - MARGIN), None)
            kept = [b for b in sure if b < min(end - MARGIN, meet if meet is not None else end)]
            if meet is None:
                last = kept.pop() if kept else sure[0]
                for m in self.pattern.finditer(text, last):
                    if m.start() in own:
                        meet = m.start()
                        break
                    kept.append(m.start())
            yield from kept
            if meet is None:  # no boundary of this chunk is sure; the text up to its end is split already
                sure = []
                return
            sure = [b for b in bounds[k] if b >= meet]
        yield from sure

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        self.learn(split)
        return [[*chain.from_iterable(map(self.kept.__getitem__, s))] for s in split]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        self.learn(split)
        return [sum(map(len, map(self.kept.__getitem__, s))) for s in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


@cache
def bpe(vocabulary: str = VOCABULARY) -> Bpe:
    """The encoder of a .tiktoken file of public_tokenizers, or of a path; one for each Python process."""
    import public_tokenizers as P

    return Bpe(vocabulary if "/" in vocabulary else P.path(vocabulary), P.PATTERN)
