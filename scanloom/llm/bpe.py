"""Encoding texts into the ids of a byte-level BPE vocabulary: speculate, verify, repair.

A text is cut into words by the vocabulary's word pattern.  For each distinct word not seen before, greedy
longest match over the vocabulary proposes tokens.  The proposal is the true encoding exactly if no merge
would ever cross a border between two neighbours, and that can be read off the two tokens alone: pieces at
the left token's right edge and at the right token's left edge exist during known spans of the merge order,
and a crossing merge needs two such pieces that meet before either is merged away.  All neighbours of a
batch are tested at once on arrays.  Only words that fail are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scanloom.session import spread

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the word pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words whose encoding a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 400_000
_NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable Latin-1 as is, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and edge tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        decode = lambda t: bytes(letters[c] for c in t)
        self.ids = {decode(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.size = max(self.ids.values()) + 1
        self.longest = max(map(len, self.ids))
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        made = np.full(self.size, -1, np.int64)
        for n, m in enumerate(model["merges"]):
            a, b = (decode(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[i, j] = (n, k)
            if left[k] < 0:
                left[k], right[k], made[k] = i, j, n
        keys = np.array([i * self.size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([n for n, _ in self.rank.values()], np.int64)[order]
        self.left_edge, self.left_end = self._edge(left, made)
        self.right_edge, self.right_end = self._edge(right, made)
        self.whole = self._reachable(left, right, made)

    @staticmethod
    def _edge(part: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the pieces that stand at one edge while it is merged, and when each is merged away."""
        piece, ends = [np.arange(len(part))], [np.full(len(part), _NEVER)]
        while True:
            at = piece[-1]
            below = np.where(at >= 0, part[np.maximum(at, 0)], -1)
            if (below < 0).all():
                return np.stack(piece, 1), np.stack(ends, 1)
            ends.append(np.where(below >= 0, made[np.maximum(at, 0)], -1))
            piece.append(below)

    def crossing(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge crosses the border between tokens a and b (before a given rank)."""
        bad = np.zeros(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            use = np.flatnonzero(x >= 0)
            if not len(use):
                break
            for j in range(self.left_edge.shape[1]):
                y = self.left_edge[b[use], j]
                use_j = use[y >= 0]
                if not len(use_j):
                    break
                key = self.right_edge[a[use_j], i] * self.size + self.left_edge[b[use_j], j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                r = np.where(self.keys[at] == key, self.ranks[at], _NEVER)
                # of equal merges the leftmost comes first: the left token's own wins, the right token's doesn't
                hit = (r < self.right_end[a[use_j], i]) & (r <= self.left_end[b[use_j], j]) & (r < _NEVER)
                if before is not None:
                    hit &= r < before[use_j]
                bad[use_j[hit]] = True
        return bad

    def _reachable(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Whether merging a token's own bytes gives the token."""
        ok = left < 0
        ok[:] = True
        merged = np.flatnonzero(left >= 0)
        ok[merged] = ~self.crossing(left[merged], right[merged], made[merged])
        for k in merged[np.argsort(made[merged])]:
            ok[k] &= ok[left[k]] and ok[right[k]]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                k = ids.get(word[at:end])
                if k is not None:
                    out.append(k)
                    at = end
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap over a linked list."""
        tok = [self.byte[b] for b in word]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if 0 <= i and nxt[i] < n and (m := self.rank.get((tok[i], tok[nxt[i]]))):
                heapq.heappush(heap, (m[0], i, tok[i], tok[nxt[i]], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = k, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Encodings of distinct words."""
        raw = [w.encode("utf-8") for w in words]
        out = [[self.ids[b]] if b in self.ids and self.whole[self.ids[b]] else self.greedy(b) for b in raw]
        several = [n for n, t in enumerate(out) if len(t) > 1 or not self.whole[t[0]]]
        if several:
            lens = np.array([len(out[n]) for n in several])
            flat = np.concatenate([np.array(out[n], np.int64) for n in several])
            owner = np.repeat(np.arange(len(several)), lens)
            inner = owner[1:] == owner[:-1]
            bad = np.zeros(len(several), bool)
            bad[owner[~self.whole[flat]]] = True
            cross = self.crossing(flat[:-1][inner], flat[1:][inner])
            bad[owner[1:][inner][cross]] = True
            for n in np.flatnonzero(bad):
                out[several[n]] = self.exact(raw[several[n]])
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> Vocabulary:
    path = f"{tokenizers}/{name}.json"
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Encoder:
    """Encodes texts, keeping the encodings of words it has met."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT_WORDS) -> None:
        self.vocab, self.kept, self.known = vocab, kept, {}
        self.split = regex.compile(PATTERN).findall

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > self.kept:
            self.known = {}
        new = list({w for ws in words for w in ws} - self.known.keys())
        if new:
            self.known.update(zip(new, self.vocab.encode_words(new), strict=True))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in words]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """id and ``ids`` (array of int) of each row; one pass, no shuffle.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text; very long
    texts are encoded whole; repeated ids give a row each; other columns are ignored; an empty table no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(name, tokenizers))
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds a batch's Python lists
                part = b.slice(at, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
