"""Packing by cutting-stock column generation.

Documents become token pieces: whole sequences where a document is longer than one, and a rest. The rests'
lengths are counted in classes of UNIT tokens. Over that histogram (at most SEQUENCE / UNIT classes, whatever
the data) a linear program chooses patterns of classes that fill a sequence; a knapsack dynamic program prices
new patterns. Rounded down, the patterns are assigned to the pieces by their rank in their class; what rounding
leaves is put into further patterns, largest first. Ranks come from counts by class and bucket, so no class is
ordered in one task, and only the histogram is on the driver.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, text_of, written

SEQUENCE, UNIT, END = 4096, 16, 2
#: Pieces of one class that are ordered in one task: LEAST, or a PARTS-th of all pieces if that is more.
LEAST, PARTS = 256, 10_000
#: Bounds of the linear program: steps, and the gap to the lower bound at which it ends.
STEPS, GAP = 3000, 5e-4
CACHED_CHUNKS = 600_000
#: Python splits at these, the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_WIDE = re.compile("[^\x00-\xff]")


@lru_cache(1)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids as little-endian bytes. No token of this vocabulary spans white space, so what stands between
    white space is encoded once and remembered. The tokenizer lower-cases; a Latin-1 text is lower-cased first,
    so that one entry serves all spellings, and a word with a stop or comma behind it takes the word's entry.
    A bounded number of entries is kept, the oldest half goes first."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.kept = _tokenizer(path), {}
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.stops = {c: self._plain(c) for c in ".,"}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Without the offsets, which nobody reads."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        return self._each([text])[0]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(i, "<u4").tobytes() for i in self._ids(texts)]

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone: one run of tokens each, whose last one ends a word."""
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.array(self._ids([" ".join(part)])[0], "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(part):
                self.kept.update((w, self._plain(w)) for w in part)
                continue
            raw = ids.tobytes()
            lo = 0
            for w, hi in zip(part, (4 * at).tolist()):
                self.kept[w] = raw[lo:hi]
                lo = hi

    def _chunks(self, text: str) -> list[str] | None:
        if "<|" in text or _ODD.search(text):  # special tokens; white space of Python's own
            return None
        return text.lower().split() if text.isascii() or not _WIDE.search(text) else text.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [self._chunks(t) for t in texts]
        kept = self.kept
        new = set().union(*filter(None, chunks)).difference(kept)
        if len(kept) + 2 * len(new) > CACHED_CHUNKS:
            for c in list(kept)[: len(kept) // 2]:
                del kept[c]
            new = set().union(*filter(None, chunks)).difference(kept)
        ended = {c: c[:-1] for c in new if c[-1] in ".," and c[:-1].isalpha()}
        simple = {c for c in new if c.isalpha()} | {w for w in ended.values() if w not in kept}
        self._learn([w for w in simple if not _WIDE.search(w)])
        others = [c for c in simple.union(new) if c not in kept and c not in ended]
        kept.update(zip(others, self._each(others)))
        for c, word in ended.items():
            kept[c] = kept[word] + self.stops[c[-1]]
        get = kept.__getitem__
        return [self._plain(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, chunks)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, whatever tasks it runs."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids as little-endian bytes."""
    docs = small_batches(docs)
    path = tokenizer or default_tokenizer()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, SEQUENCE):
                        own = ids[4 * s : 4 * (s + SEQUENCE)]
                        rows.append((i, s, len(own) // 4, zlib.crc32(own), n, own if keep_ids else None))
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, [pa.int64()] * 5 + [pa.binary()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return out if keep_ids else out.drop("ids")


def _best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the filled units."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = sizes <= r
        best[r] = best[r - 1]
        if fits.any():
            gain = np.where(fits, best[np.maximum(r - sizes, 0)] + value, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[r] + 1e-12:
                best[r], choice[r] = gain[k], k
    pattern, r = np.zeros(len(sizes)), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            pattern[choice[r]] += 1
            r -= int(sizes[choice[r]])
    return float(best[room]), pattern


def patterns(histogram: dict[int, int], room: int = SEQUENCE // UNIT) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: how many}) that together hold every piece of the histogram of sizes in units."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n > 0), reverse=True), int)
    left = {int(s): int(histogram[int(s)]) for s in sizes}
    out: list[tuple[int, dict[int, int]]] = []
    if len(sizes):
        demand = np.array([histogram[int(s)] for s in sizes], float)
        basis = np.diag((room // sizes).astype(float))
        x = np.linalg.solve(basis, demand)
        for _ in range(STEPS):
            dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
            worth, column = _best_pattern(np.maximum(dual, 0), sizes, room)
            if worth <= 1 + GAP:  # x.sum() / worth is a lower bound
                break
            d = np.linalg.solve(basis, column)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            k = int(ratio.argmin())
            step = ratio[k]
            x = np.maximum(x - step * d, 0)
            x[k] = step
            basis[:, k] = column
        for k in range(len(sizes)):
            times = int(np.floor(x[k] + 1e-7))
            own = {int(s): int(a) for s, a in zip(sizes, basis[:, k]) if a > 0}
            times = min([times, *(left[s] // a for s, a in own.items())])
            if times > 0:
                out.append((times, own))
                for s, a in own.items():
                    left[s] -= times * a
    while any(left.values()):  # largest first into one more sequence, as often as it goes
        free, own = room, {}
        for s in sorted(left, reverse=True):
            a = min(left[s], free // s)
            if a:
                own[s], free = a, free - a * s
        times = min(left[s] // a for s, a in own.items())
        out.append((times, own))
        for s, a in own.items():
            left[s] -= times * a
    return out


def pack(parts: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = parts.sparkSession
    p = written(parts)
    unit = F.ceil(F.col("length") / UNIT).cast("int").alias("unit")
    full = SEQUENCE // UNIT
    histogram = {r[0]: r[1] for r in p.select(unit).groupBy("unit").count().collect()}
    most = max(LEAST, sum(histogram.values()) // PARTS)
    dealt = F.broadcast(spark.createDataFrame([(u, -(-n // most)) for u, n in histogram.items()] or [(full, 1)], "unit int, buckets int"))  # a row per class
    slots, first = [], 0
    taken: dict[int, int] = {}
    for times, own in patterns(histogram):
        for s, a in own.items():
            lo = taken.get(s, 0)
            slots.append((s, lo, lo + times * a, a, first))
            taken[s] = lo + times * a
        first += times
    table = F.broadcast(spark.createDataFrame(slots or [(full + 1, 0, 0, 1, 0)], "unit int, lo long, hi long, each int, first long"))  # at most a few thousand rows: classes x patterns
    b = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")).cast("int")
    rows = p.select("*", unit).join(dealt, "unit").withColumn("bucket", b).drop("buckets")
    before = rows.groupBy("unit", "bucket").count().select("unit", "bucket", (F.sum("count").over(Window.partitionBy("unit").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("unit", "bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(before, ["unit", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(table, "unit").where("rank >= lo and rank < hi").withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("unit"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("long"))).select(*p.columns, F.col("sequence_id").cast("long"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), keep_ids=False))
