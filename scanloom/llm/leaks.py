"""Evaluation texts inside training texts, by pigeonhole edit matching.

An item's passages are its runs of ``window`` words (a shorter item is one passage).  With a budget of ``k``
word edits a passage is cut into ``k + 1`` pieces; whatever k edits do, one piece stays whole, so every
document that holds the passage within the budget holds a piece exactly.  Pieces are looked up in one
dictionary while a document is read, and each hit is verified by bit-parallel edit distance (one machine
word holds a whole column of the dynamic programme) around the place it points to.

The budget goes with the passage's length: one edit for every ``WORDS_AN_EDIT`` words, so that a short item isn't
found in a text that shares a word with it.  Items go to the tasks in blocks of a checked size, whose index is built
once in each Python worker; documents are read once per block and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.session import spread

WINDOW = 13
EDITS = 2
WORDS_AN_EDIT = 5
#: Characters of item text that one block may hold; its index takes about eighty times as many bytes.
BLOCK_CHARS = 4 << 20

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def pieces(start: int, length: int, count: int) -> list[tuple[int, int]]:
    """``count`` adjoining pieces (start, length) of a passage, as even as can be."""
    cuts = [start + length * n // count for n in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def column_masks(passage: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for n, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | 1 << n
    return masks


def best_distance(masks: dict[int, int], m: int, text: list[int], limit: int) -> int:
    """Least edit distance of the passage to any run of ``text``; stops at 0; over ``limit`` means none."""
    last, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(diag | plus) & full), plus & diag
        score += bool(up & last) - bool(down & last)
        if score < best:
            best = score
            if not best:
                return 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (~(diag | up) & full), up & diag
    return best if best <= limit else limit + 1


def budget(words: int, edits: int) -> int:
    return min(edits, words // WORDS_AN_EDIT)


class Index:
    """Pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, edits: int) -> None:
        self.window, self.edits = window, edits
        self.word: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.pieces: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        self.masks: dict[tuple[int, int], dict[int, int]] = {}
        for item_id, text in items:
            ws = [self.word.setdefault(w, len(self.word)) for w in words_of(text)]
            if not ws:
                continue
            n = len(self.items)
            self.items.append((item_id, ws))
            m = min(len(ws), window)
            count = budget(m, edits) + 1
            for start in range(len(ws) - m + 1):
                for a, k in pieces(start, m, count):
                    at = self.pieces.setdefault(tuple(ws[a : a + k]), [])
                    at.append((n, start, a))
        self.lengths = sorted({len(k) for k in self.pieces})

    def search(self, text: str | None) -> dict[int, int]:
        """Item id → least distance of one of its passages to a run of the text, within the budget."""
        get = self.word.get
        ws = [get(w, -1) for w in words_of(text)]
        best: dict[int, int] = {}
        seen: set[tuple[int, int, int]] = set()
        for at in range(len(ws)):
            for k in self.lengths:
                if ws[at + k - 1 : at + k] in ([], [-1]):
                    break
                for n, start, a in self.pieces.get(tuple(ws[at : at + k]), ()):
                    where = (n, start, at - a)
                    if where in seen or best.get(n) == 0:
                        continue
                    seen.add(where)
                    passage = self.items[n][1]
                    m = min(len(passage), self.window)
                    limit = budget(m, self.edits)
                    masks = self.masks.get((n, start))
                    if masks is None:
                        masks = self.masks[n, start] = column_masks(passage[start : start + m])
                    low = max(0, at - a + start - limit)
                    d = best_distance(masks, m, ws[low : at - a + start + m + limit], limit)
                    if d <= limit and d < best.get(n, limit + 1):
                        best[n] = d
        out: dict[int, int] = {}
        for n, d in best.items():
            i = self.items[n][0]
            out[i] = min(d, out.get(i, d))
        return out


_BUILT: dict[tuple, Index] = {}


def _index_of(key: tuple, items: list[tuple[int, str | None]], window: int, edits: int) -> Index:
    """The block's index, built once per worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items, window, edits)
    return _BUILT[key]


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits: the least number of word edits between a passage of the item and the document.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored.  Pairs within the budget (``edits``, or one edit for
    every five words of a shorter item) come out once.  ``edits`` 0 means that ``window`` words of the item stand in the document in a row, or all words
    of a shorter item.  Texts without a word match nothing; repeated documents give equal rows, of which one
    stays; empty tables give no rows.  The items are collected in blocks of at most ``block_chars`` characters
    (a single longer item is a block of its own).
    """
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, edits int"
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars) * (2 if total > block_chars else 1))
    parts = []
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).select("item_id", "text").collect()
        index = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index=index, key=(uuid.uuid4().hex, n)) -> Iterator[pa.RecordBatch]:
            found = _index_of(key, index.value, window, edits)
            for b in batches:
                doc, item, dist = [], [], []
                for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for i, e in found.search(text).items():
                        doc.append(d)
                        item.append(i)
                        dist.append(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, b.schema.field(0).type), pa.array(item, pa.int64()), pa.array(dist, pa.int32())], names=["doc_id", "item_id", "edits"]
                )

        parts.append(spread(docs.select("doc_id", "text").where("text is not null")).mapInArrow(run, kinds))
    out = reduce(DataFrame.unionByName, parts)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
