"""Evaluation texts leaking into training text.

Windows of item size slide over items and documents: of ``window`` words, or of a whole
item where that is shorter. The CGK random walk embeds a window of words into a longer
string such that few edits change few places; keys of sampled places (bit-sampling LSH)
then meet for similar windows, with a number of repetitions that follows from the recall
wanted. Every meeting is verified by the exact edit distance of the two windows.

A document window is walked only if enough of its neighbouring word pairs occur in items
at all: an edit touches two pairs at most, so no window within reach is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread
from codeloom.llm.words import K, letters, mix, word_hashes

_WORD = letters()
STRETCH = 2  # length of the embedding in windows: a walk moves at every other step, so that few places lie beyond its end
BLOCK_BYTES = 32 << 20  # item text that is broadcast at a time; more is searched for in blocks


def repetitions(max_edits: int, window: int, samples: int, recall: float) -> int:
    """Repetitions after which windows within ``max_edits`` edits have met with probability ``recall``.

    An edit sets the two walks apart for as long as it takes them to meet again, in the
    median some four steps, so that e edits change about 4 e of the 2 w places.
    """
    same = max(0.05, 1 - 4 * max_edits / (STRETCH * window)) ** samples
    return 1 if same >= recall else ceil(log(1 - recall) / log(1 - same))


def window_keys(words: np.ndarray, starts: np.ndarray, window: int, samples: int, rep: int) -> np.ndarray:
    """LSH keys of the windows that begin at ``starts``, for one repetition.

    The walk copies a word and moves on or stays as a random bit of (step, word) says; the
    bits of all steps of a word are drawn at once.
    """
    rng = np.random.default_rng(7919 * rep + 1)
    taken = set(rng.choice(STRETCH * window, size=min(samples, STRETCH * window), replace=False).tolist())
    coins = mix(words ^ np.uint64(rng.integers(1, 2**63)))
    more = mix(coins + K)  # steps from 64 on
    at = np.zeros(len(starts), dtype=np.int64)
    key = np.full(len(starts), rep + 1, dtype=np.uint64)
    for step in range(max(taken) + 1):
        here = starts + np.minimum(at, window - 1)
        live = at < window
        if step in taken:
            key = mix(key * K + np.where(live, words[here], np.uint64(0)))
        bits = coins if step < 64 else more
        at += ((bits[here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64) * live
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Edit distances of paired windows (rows of two matrices of one width), all pairs at once.

    With ``most`` only the band around the diagonal that such distances need is computed; larger distances come out as ``most + 1`` or more.
    """
    n = a.shape[1]
    w = n if most is None else min(most, n)
    far = n + 1
    row = np.full((len(a), 2 * w + 1), far, dtype=np.int16)  # column c of row i stands for position i + c - w of the second window
    row[:, w:] = np.arange(w + 1)
    for i in range(1, n + 1):
        prev, row = row, np.full_like(row, far)
        for c in range(max(0, w - i), min(2 * w, n - i + w) + 1):
            j = i + c - w
            best = prev[:, c] + (a[:, i - 1] != b[:, j - 1]) if j else np.full(len(a), i, dtype=np.int16)
            if c < 2 * w:
                best = np.minimum(best, prev[:, c + 1] + 1)
            if c and j:
                best = np.minimum(best, row[:, c - 1] + 1)
            row[:, c] = best
    return row[:, w].astype(np.int64)


def _windows(row: np.ndarray, window: int) -> np.ndarray:
    """First positions of all windows that lie within one text."""
    last = len(row) - window + 1
    return np.flatnonzero(row[:last] == row[window - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)


class _Items:
    """The distinct windows of one length over all items, each with the items that hold it, and their LSH keys."""

    def __init__(self, row: np.ndarray, words: np.ndarray, starts: np.ndarray, window: int, samples: int, reps: int, max_edits: int):
        self.window, self.edits, self.samples = window, max_edits, samples
        rows = words[starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), dtype=np.uint64)
        self.words, which = np.unique(rows, axis=0, return_inverse=True)
        held = np.unique(np.stack([which.ravel(), row[starts]], axis=1), axis=0) if len(starts) else np.zeros((0, 2), dtype=np.int64)
        self.item = held[:, 1]
        self.first = np.searchsorted(held[:, 0], np.arange(len(self.words) + 1))
        flat, at = self.words.ravel(), np.arange(len(self.words)) * window
        self.pairs = np.unique(_pairs(self.words[:, :-1].ravel(), self.words[:, 1:].ravel()))
        self.index = []
        for r in range(reps):
            keys = window_keys(flat, at, window, samples, r)
            order = np.argsort(keys, kind="stable")
            self.index.append((keys[order], order))

    def meetings(self, row: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(first word of a document window, number of an item window) of all windows that share a key, each once."""
        start = self._near(_windows(row, self.window), words)
        met = [np.zeros(0, dtype=np.int64)]
        for r, (keys, where) in enumerate(self.index if len(start) else ()):
            mine = window_keys(words, start, self.window, self.samples, r)
            lo = np.searchsorted(keys, mine)
            n = np.searchsorted(keys, mine, side="right") - lo
            each = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            met.append(np.repeat(start, n) * len(self.words) + where[each])
        pair = np.unique(np.concatenate(met))
        return np.stack(np.divmod(pair, max(1, len(self.words))), axis=1)

    def _near(self, start: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The windows of which enough neighbouring word pairs occur in items: all that can lie within the edits allowed."""
        if not len(start) or not len(self.words):
            return start[:0]
        if self.window == 1:
            return start
        pair = _pairs(words[:-1], words[1:])
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = np.r_[0, np.cumsum(self.pairs[at] == pair)]
        return start[known[start + self.window - 1] - known[start] >= self.window - 1 - 2 * self.edits]

    def verified(self, row: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(row, item, edits) of every meeting within the edits allowed, for each item that holds the window."""
        met, span = self.meetings(row, words), np.arange(self.window)
        out = [np.zeros((0, 3), dtype=np.int64)]
        for c in range(0, len(met), 50_000):
            p = met[c : c + 50_000]
            d = edit_distances(words[p[:, :1] + span], self.words[p[:, 1]], self.edits)
            p, d = p[d <= self.edits], d[d <= self.edits]
            n = self.first[p[:, 1] + 1] - self.first[p[:, 1]]
            each = np.repeat(self.first[p[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack([np.repeat(row[p[:, 0]], n), self.item[each], np.repeat(d, n)], axis=1))
        return np.concatenate(out)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * K + b)


def _search(batches: Iterator[pa.RecordBatch], items: Broadcast, window: int, samples: int, max_edits: int, recall: float) -> Iterator[pa.RecordBatch]:
    table = pa.ipc.open_stream(items.value).read_all()
    irow, iwords = word_hashes(table.column("text").combine_chunks(), _WORD)
    ids = table.column("item_id").to_numpy()
    size = np.bincount(irow, minlength=len(table))
    groups = []
    for w in sorted({min(int(n), window) for n in size if n}):
        edits = max_edits * w // window
        starts = _windows(irow, w)
        starts = starts if w == window else starts[size[irow[starts]] == w]
        groups.append(_Items(irow, iwords, starts, w, samples, repetitions(edits, w, samples, recall), edits))
    for b in batches:
        row, words = word_hashes(b.column("text"), _WORD)
        found = np.concatenate([np.zeros((0, 3), dtype=np.int64), *(g.verified(row, words) for g in groups)])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        n = np.diff(np.r_[np.flatnonzero(new), len(found)]) if len(found) else np.zeros(0, dtype=np.int64)
        best = found[new]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(best[:, 0])), pa.array(ids[best[:, 1]] if len(best) else np.zeros(0, dtype=np.int64), pa.int64()), pa.array(best[:, 2].astype(np.int32)), pa.array(n.astype(np.int64))],
            ["doc_id", "item_id", "edits", "n_windows"],
        )


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 13, max_edits: int = 2, samples: int = 6, recall: float = 0.95, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, item_id, edits, n_windows``: documents with a window of words that some item has too, but for a few edits.

    Words are the longest runs of ``A-Z a-z 0-9`` in lower case. ``edits`` is the smallest edit
    distance (in words) of two windows that met, at most ``max_edits``; an item of fewer
    words than ``window`` is one window of its own length and may differ by its share of
    the edits (rounded down). ``n_windows`` counts pairs of windows that passed. Windows that are
    equal always meet, so those with 0 edits are all found; others meet with probability
    ``recall`` or more. Texts without a word, null and empty ones give no row. Documents are
    never shuffled, whatever they hold. Items are the query set: they travel to the tasks in
    broadcasts of about ``block_bytes`` of text at most, and each block passes over the documents once.
    """
    docs = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null"))
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null").distinct()
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):
        part = documents.sparkSession.sparkContext.broadcast(_packed(held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()))
        got = docs.mapInArrow(partial(_search, items=part, window=window, samples=samples, max_edits=max_edits, recall=recall), "doc_id long, item_id long, edits int, n_windows long")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.sum("n_windows").alias("n_windows"))
