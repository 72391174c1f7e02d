"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Two strings within k edits share at least m - q + 1 - k q of the q-grams of the one with m characters, all
of them on k + 1 neighbouring diagonals. Per document the q-grams that the benchmark also has are counted in
overlapping diagonal bands; bands that reach the bound are merged where they touch and verified by a banded
alignment of the whole item within the region. The benchmark is the stated query set: its index is made of
blocks of about BLOCK_CHARS characters, each of which passes over all documents once. Where a text and an item repeat
themselves so much that the pairs of their positions are too many, they are marked in a table of bands by positions,
which is no larger than a few times the text, item by item.

Compared are lower-cased texts in which runs of white space are one space; spans are code points of the
original text. An item shorter than q characters counts only where it stands exactly.

Defined results: null or empty texts and items match nothing; an item given twice is found twice under its
ids; repeated documents are reported per row; the best alignment of each region is returned (ties: the one
that ends first); a very long text is read in overlapping parts; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, text_of

Q = 8
#: Edits per character of an item that still count as the item.
EDITS = 0.1
#: Characters of the items in an index.
BLOCK_CHARS = 2_000_000
#: Positions of a document looked at together, and pairs of positions held at once.
SPAN, PAIRS = 1 << 16, 2_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points to compare, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    space = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
    cp[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = not space[0]
    at = np.flatnonzero(keep)
    return cp[at], at


def grams(cp: np.ndarray) -> np.ndarray:
    """One 64-bit value per q-gram, of a byte per character: equal grams have equal values."""
    x = ((cp ^ (cp >> 8)) & 0xFF).astype(np.uint8)
    n = len(x) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for o in range(min(Q, max(n, 0))):
        part = x[o : o + (len(x) - o) // Q * Q].view("<u8")
        out[o::Q] = part[: len(out[o::Q])]
    return out


class Index:
    """Postings of the q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.cps = [], []
        for i, text in items:
            cp = normal(text)[0]
            while len(cp) and cp[-1] == 32:
                cp = cp[:-1]
            if len(cp):
                self.ids.append(i)
                self.cps.append(cp)
        self.m = np.array([len(x) for x in self.cps], np.int64)
        self.k = np.maximum(0, np.minimum((self.m * EDITS).astype(np.int64), (self.m - Q) // Q))
        self.least = np.maximum(1, self.m - Q + 1 - self.k * Q)
        gs = [grams(x) for x in self.cps]
        g = np.concatenate(gs) if gs else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(gs)), [len(x) for x in gs]) if gs else np.empty(0, np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in gs]) if gs else np.empty(0, np.int64)
        by = np.argsort(g, kind="stable")
        self.item, self.pos = item[by], pos[by]
        self.g, self.first, self.n = np.unique(g[by], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.g * _MULT) >> np.uint64(64 - _BITS)] = True
        self.short = [i for i in range(len(self.ids)) if self.m[i] < Q]
        self.reach = int((self.m + 4 * self.k).max(initial=0)) + 2 * Q

    def regions(self, g: np.ndarray, start: int) -> list[tuple[int, int, int, int]]:
        """(item, lowest diagonal, highest diagonal, shared q-grams) of the bands that reach the bound."""
        near = np.flatnonzero(self.bits[(g * _MULT) >> np.uint64(64 - _BITS)])
        if not len(near) or not len(self.g):
            return []
        row = np.searchsorted(self.g, g[near])
        row[row == len(self.g)] = 0
        ok = self.g[row] == g[near]
        near, row = near[ok], row[ok]
        n = self.n[row]
        total = int(n.sum())
        if total < self.least.min():
            return []
        if total > PAIRS:  # very repetitive text
            return [x for i in range(len(self.m)) for x in self._repetitive(i, near, row, start)]
        each = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(total)
        item, pos = self.item[each], self.pos[each]
        few = np.bincount(item, minlength=len(self.m)) >= self.least
        use = few[item]
        if not use.any():
            return []
        item, pos, at = item[use], pos[use], np.repeat(near, n)[use] + start
        diagonal = at - pos
        wide = self.k[item] + 1
        band = diagonal // wide
        found = []
        # one number for item, band and place in the item; a band more for those that overlap
        low = int(band.min()) - 1
        wide, long = int(band.max()) - low + 1, int(self.m.max())
        at_band = item * wide + (band - low)
        n = np.bincount(at_band - item.min() * wide) if wide * (int(item.max() - item.min()) + 1) < 4 * PAIRS else None
        if n is not None:  # the bound on two bands together leaves few of the pairs to be sorted
            both = n + np.append(n[1:], 0)
            most = np.maximum(both, np.append(0, both[:-1]))[at_band - item.min() * wide]
            use = most >= self.least[item]
            if not use.any():
                return []
            at_band, pos = at_band[use], pos[use]
        key = np.concatenate([at_band, at_band - 1]) * long + np.tile(pos, 2)
        at_band, n = np.unique(np.unique(key) // long, return_counts=True)
        item, band = at_band // wide, at_band % wide + low
        ok = n >= self.least[item]
        for i, b, c in zip(item[ok].tolist(), band[ok].tolist(), n[ok].tolist()):
            w = int(self.k[i]) + 1
            lo, hi = b * w, (b + 2) * w - 1
            if found and found[-1][0] == i and lo <= found[-1][2] + 1:
                found[-1] = (i, found[-1][1], hi, max(c, found[-1][3]))
            else:
                found.append((i, lo, hi, c))
        return found


    def _repetitive(self, i: int, near: np.ndarray, row: np.ndarray, start: int) -> list[tuple[int, int, int, int]]:
        """The same for one item, from a table of bands by positions that is filled part by part."""
        own = self.item == i
        rows, pos = np.repeat(np.arange(len(self.g)), self.n)[own], self.pos[own]
        first, n = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
        n -= first
        if n.sum() < self.least[i]:
            return []
        at, first, n = near[n > 0] + start, first[n > 0], n[n > 0]
        wide, m = int(self.k[i]) + 1, int(self.m[i])
        low = (int(at[0]) - m) // wide - 1
        seen = np.zeros(((int(at[-1]) // wide) - low + 1, m), bool)
        ends = np.cumsum(n)
        done = 0
        while done < len(n):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS // 4, side="right")))
            k = n[done:stop]
            p = pos[np.repeat(first[done:stop] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            band = (np.repeat(at[done:stop], k) - p) // wide - low
            seen[band, p] = True
            done = stop
        both = (seen[:-1] | seen[1:]).sum(axis=1)  # a band and the next, as bands overlap
        found: list[tuple[int, int, int, int]] = []
        for b in np.flatnonzero(both >= self.least[i]).tolist():
            lo, hi, c = (b + low) * wide, (b + low + 2) * wide - 1, int(both[b])
            if found and lo <= found[-1][2] + 1:
                found[-1] = (i, found[-1][1], hi, max(c, found[-1][3]))
            else:
                found.append((i, lo, hi, c))
        return found


def exact(item: np.ndarray, text: np.ndarray) -> int | None:
    """Where the item first stands in text as it is."""
    a, b, s = item.tobytes(), text.tobytes(), -1
    while (s := b.find(a, s + 1)) >= 0:
        if s % 4 == 0:
            return s // 4
    return None


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, most: int) -> tuple[int, int] | None:
    """The fewest edits that turn the whole item into a piece of text on the diagonals lo..hi, and where that piece ends; None beyond `most`."""
    d = np.arange(lo, hi + 1)
    far = most + 1
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    for i, c in enumerate(item):
        j = d + i  # the text's character that this step may use
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(len(d), bool)
        same[inside] = text[j[inside]] == c
        new = row + np.where(inside, ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(j + 1 < 0) | (j + 1 > len(text))] = far
        new = np.minimum.accumulate(new - d) + d  # characters of the text alone
        row = np.minimum(new, far)
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), int(d[best] + len(item))


def matches(index: Index, text: str) -> list[tuple[int, int, int, int, int]]:
    """(item_id, start, end, edits, shared q-grams) of every region that holds an item."""
    cp, at = normal(text)
    found, g = set(), grams(cp)
    regions: list[tuple[int, int, int, int]] = []
    for start in range(0, max(len(g), 1), SPAN):
        regions += index.regions(g[start : start + SPAN + index.reach], start)
    for i, lo, hi, shared in regions:
        item, k = index.cps[i], int(index.k[i])
        lo, hi = max(lo - k, -len(item)), min(hi + k, len(cp))
        if (s := exact(item, cp[max(lo, 0) : hi + len(item)])) is not None:
            s += max(lo, 0)
            found.add((index.ids[i], int(at[s]), int(at[s + len(item) - 1]) + 1, 0, shared))
            continue
        if (end := align(item, cp, lo, hi, k)) is None:
            continue
        edits, e = end
        piece = cp[max(0, e - len(item) - k) : e]
        back = align(item[::-1], piece[::-1], -k, k, k)  # anchored at the end that was found
        start = e - (back[1] if back else len(item))
        if e > start >= 0:
            found.add((index.ids[i], int(at[start]), int(at[e - 1]) + 1, edits, shared))
    for i in index.short:
        item = index.cps[i]
        if len(cp) >= len(item):
            for s in np.flatnonzero((np.lib.stride_tricks.sliding_window_view(cp, len(item)) == item).all(axis=1)).tolist():
                found.add((index.ids[i], int(at[s]), int(at[s + len(item) - 1]) + 1, 0, 0))
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    for i, s, e, edits, shared in found:
        old = best.get((i, s, e))
        best[i, s, e] = min(old, (edits, -shared)) if old else (edits, -shared)
    return sorted((i, s, e, edits, -shared) for (i, s, e), (edits, shared) in best.items())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, of which the driver holds one at a time."""
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        yield sorted((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per region of a document that holds a benchmark item: doc_id, item_id, start, end, edits, shared_grams."""
    docs = small_batches(docs)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    items = _items(benchmark)
    schema = "doc_id long, item_id long, start long, end long, edits int, shared_grams int"

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for b in batches:
                rows = [(i, *m) for i, x in zip(b.column(0).to_pylist(), b.column(1)) for m in matches(index, x.as_py())]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "start", "end", "edits", "shared_grams"])

        return texts.mapInArrow(run, schema)

    out = None
    for block in _blocks(items):
        part = scan(block)
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    docs = small_batches(docs)

    def without(block: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for b in batches:
                yield b.filter(pa.array([not matches(index, x.as_py() or "") for x in b.column(text_col)], pa.bool_()))

        return run

    for block in _blocks(_items(benchmark)):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
