"""Passages of held-out items inside training documents, by spaced-seed hashing.

A seed is a mask over consecutive words that ignores some positions, so a passage with a few substituted words still hits. The hashes of every item's
windows under each mask are joined with the hashes of every document's windows; around each hit the diagonal is compared word by word, in a window.
TOLERANT masks are a lossless family: whichever WINDOW - MIN_WORDS words of WINDOW are substituted, the masks still fit between them, and how often at least is
counted over all of these patterns. So a passage with MIN_WORDS equal words within WINDOW is always found, and a diagonal with fewer hits is none.
The corpus is scanned once, whatever the number of items, and never shuffled; the items' tables are built once, in blocks, and broadcast.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

WORD = re.compile(r"[^\W_]+")
#: Masks over consecutive words: 1 is compared, 0 ignored. None is longer than the passage to be found, so every exact passage hits every mask.
MASKS = ("110110101101", "101101110011")
#: Words of a diagonal in which MIN_WORDS equal ones make a passage with substitutions.
WINDOW = 18
#: Every way to substitute 6 of 18 words leaves at least ten places for these (``least_hits``), so diagonals with less need no comparison.
TOLERANT = ("11", "101")
#: Consecutive equal words that make a passage.
MIN_WORDS = 12
#: Items are indexed in blocks of at most this many words.
BLOCK_WORDS = 2_000_000

SCHEMA = "doc_id long, item_id long, run_words int, matched int, compared int, doc_word int, item_word int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("run_words", "matched", "compared", "doc_word", "item_word")]])


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


class SeedIndex:
    """The windows of one block of items, as sorted hashes with their place in the concatenated items."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...]):
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]
        self.span = [len(m) for m in masks]
        self.vocabulary: dict[str, int] = {}
        stream, owner, self.begin, self.ids = [], [], [], []
        for k, (item_id, text) in enumerate(items):
            self.begin.append(len(stream))
            self.ids.append(item_id)
            for w in words_of(text):
                stream.append(self.vocabulary.setdefault(w, len(self.vocabulary)))
                owner.append(k)
        self.stream, self.owner = np.array(stream, np.int64), np.array(owner, np.int64)
        rng = np.random.RandomState(7)
        self.factors = [rng.randint(1, 1 << 62, size=len(m), dtype=np.int64) | 1 for m in self.masks]
        self.tables = []
        for j, span in enumerate(self.span):
            n = len(self.stream) - span + 1
            if n <= 0:
                self.tables.append((np.array([], np.int64), np.array([], np.int64)))
                continue
            at = np.flatnonzero(self.owner[:n] == self.owner[span - 1 :])
            h = self.hashes(self.stream, j)[at]
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order]))
        # A quick test for windows: the low bits of every hash that occurs.
        self.filters = []
        for h, _ in self.tables:
            bits = np.zeros(1 << 20, bool)
            bits[h & 0xFFFFF] = True
            self.filters.append(bits)

    def hashes(self, words: np.ndarray, j: int) -> np.ndarray:
        n = len(words) - self.span[j] + 1
        out = np.zeros(max(n, 0), np.int64)
        with np.errstate(over="ignore"):
            for f, off in zip(self.factors[j], self.masks[j]):
                out += words[off : off + n] * f
            out ^= (out >> 29) & 0x7FFFFFFFF
        return out

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def best_window(same: np.ndarray, width: int) -> tuple[int, int]:
    """(equal words, first place) of the window of ``width`` words, or of all if there are fewer, that holds most equal words; the first of equal ones."""
    if len(same) <= width:
        return int(same.sum()), 0
    upto = np.concatenate([[0], np.cumsum(same)])
    held = upto[width:] - upto[:-width]
    i = int(held.argmax())
    return int(held[i]), i


@lru_cache(maxsize=16)
def least_hits(masks: tuple[str, ...], matched: int, window: int) -> int:
    """Hits, over all masks, that a diagonal has at least if ``matched`` of ``window`` words are equal: every pattern is tried. 1 where there are too many to try or masks that miss one."""
    if not 0 < matched <= window or math.comb(window, matched) > 200_000:
        return 1
    patterns = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(window), matched)], np.int64)
    hits = np.zeros(len(patterns), np.int64)
    for m in masks:
        bits = sum(1 << i for i, c in enumerate(m) if c == "1")
        for o in range(window - len(m) + 1):
            hits += (patterns & (bits << o)) == (bits << o)
    return max(1, int(hits.min()))


def _overlaps(index: SeedIndex, words: np.ndarray, min_run: int, min_matched: int | None = None, window: int = WINDOW, least: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """Per item hit in one document: (item, longest equal run, equal words of the best window, words of that window, where it begins in the document and in the item).

    Of the diagonals that have a long enough run or a window with enough equal words, each by itself, the one with the longest run. Without ``min_matched`` the place is that of the run.
    """
    hits = []
    for j in range(len(index.masks)):
        table, place = index.tables[j]
        if len(words) < index.span[j] or not len(table):
            continue
        known = words >= 0
        n = len(words) - index.span[j] + 1
        # Windows all of whose compared words occur in some item.
        seen = np.ones(n, bool)
        for off in index.masks[j]:
            seen &= known[off : off + n]
        at = np.flatnonzero(seen)
        if not len(at):
            continue
        h = index.hashes(words, j)[at]
        keep = index.filters[j][h & 0xFFFFF]
        at, h = at[keep], h[keep]
        lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
        counts = hi - lo
        if not counts.sum():
            continue
        rep = np.repeat(np.arange(len(at)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hits.append(np.stack([at[rep], place[lo[rep] + inside]], axis=1))
    diagonals = [np.stack([index.owner[h[:, 1]], h[:, 0] - h[:, 1]], axis=1) for h in hits]
    if not diagonals:
        return []
    # One comparison a (item, diagonal): all hits on it lie in the same overlap of document and item.
    found = np.concatenate(diagonals)
    keys = np.sort((found[:, 0] << 40) + found[:, 1] + (1 << 39))
    if len(keys) < least:
        return []
    if least > 1:  # a diagonal with too few hits cannot hold what is asked for
        keys = keys[least - 1 :][keys[least - 1 :] == keys[: len(keys) - least + 1]]
    keys = np.unique(keys)
    diagonals = np.stack([keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)], axis=1)
    best: dict[int, tuple] = {}
    total = len(index.stream)
    for k, d in diagonals.tolist():
        begin = index.begin[k]
        end = index.begin[k + 1] if k + 1 < len(index.begin) else total
        lo, hi = max(begin, -d), min(end, len(words) - d)
        same = index.stream[lo:hi] == words[lo + d : hi + d]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        runs = edge[1::2] - edge[::2]
        if not len(runs):
            continue
        i = int(runs.argmax())
        matched, at = (int(runs[i]), int(edge[2 * i])) if min_matched is None else best_window(same, window)
        if runs[i] < min_run and (min_matched is None or matched < min_matched):
            continue
        row = (int(runs[i]), matched, int(runs[i]) if min_matched is None else min(window, hi - lo), lo + at + d, lo + at - begin)
        if k not in best or row > best[k]:
            best[k] = row
    return [(index.ids[k], *row) for k, row in best.items()]


def passages(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, min_run: int = MIN_WORDS, min_matched: int | None = None, window: int = WINDOW, masks: tuple[str, ...] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, run_words, matched, compared, doc_word, item_word) of every document and item that share a passage.

    A pair is kept if its longest run of equal consecutive words has at least ``min_run`` words or, with ``min_matched``, if some ``window`` consecutive words of a diagonal hold that
    many equal ones (substitutions allowed); its row is of the diagonal with the longest run among those that meet one of the two. matched and compared are of the window that holds
    most, doc_word and item_word where it begins (without ``min_matched``: of the run). Every exact passage of at least the masks' span is found; a shorter
    ``min_run`` than the span is refused. With the masks TOLERANT every window with MIN_WORDS of WINDOW equal words is found too; other masks, or less equal words, may lose some.
    Null texts and ids match nothing; repeated items count once; repeated document rows give repeated results. Texts are read whole, whatever their length.
    """
    masks = masks or (MASKS if min_matched is None else TOLERANT)
    if min_run < max(map(len, masks)):
        raise ValueError("a mask longer than the passage would miss it")
    known = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("t")).distinct()
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = [documents.sparkSession.sparkContext.broadcast(SeedIndex(block, masks)) for block in item_blocks(known, block_words)]
    if not shared:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    least = 1 if min_matched is None else min(least_hits(masks, min_matched, window), least_hits(masks, min_run, min_run))
    return spread(docs).mapInArrow(_searcher(shared, min_run, min_matched, window, least), SCHEMA)


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of at most ``block_words`` words (one item may exceed it alone); one partition is read at a time."""
    block, size = [], 0
    for row in items.orderBy("i", "t").toLocalIterator():
        n = len(row["t"]) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    if block:
        yield block


def _searcher(shared: list, min_run: int, min_matched: int | None, window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                for block in shared:
                    rows += [(doc, *row) for row in _overlaps(block.value, block.value.encode(found), min_run, min_matched, window, least)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

    return run
