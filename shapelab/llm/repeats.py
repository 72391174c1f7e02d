"""Bytes of texts that lie in a repeated string of SPAN bytes, by buckets of suffixes that are refined level by level.

The bucket of a place at depth q is the identifier of its q-gram; the bucket at depth 2h is made from those at depth h of
the place and of the place h later, so that each level reuses the last one, up to SPAN = 16 q. Places needn't all be
kept: the string at i stands under the place of the smallest q-gram among its first WINDOW ones, which only its content
decides, so that equal strings stand under places of one bucket at depth CORE. Neighbouring strings under one place
are a run.

* A run alone in its bucket at depth CORE is settled: none of its strings repeats.
* Runs that are equal as a whole (from the first byte of their first string to the last byte of their last one) are
  settled: all of their strings repeat.
* What is left meets other runs in its bucket, around the ends of repeated passages. It is cut in shorter runs, and so is
  one of each set of equal runs in the bucket; these have deeper buckets, and the same is done again (STEPS), until a run
  is a single string and its bucket has depth SPAN.

Counts are combined before they are shuffled, and buckets of very many runs are dealt over tasks. Equal texts are one
text with a number. Texts are written once, in buckets by key, so that later steps read them without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators.skew import hot_of, spread_join
from shapelab.session import checkpoint_folder

from .common import documents, text_of, written

#: Bytes of a string that must not repeat, of the first buckets, and of those that hold a run; first q-grams of a string among which the smallest is taken.
SPAN, Q, CORE = 400, 25, 200
WINDOW = SPAN - CORE + 1
#: Strings of a run at the later levels; SPAN - CORE + 1 at most at the first.
STEPS = (25, 1)
#: Strings of a text that are looked at together; a place in them has BITS bits.
BITS = 21
PIECE = (1 << BITS) - SPAN
ODD, MIX, LATER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BYTES = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]).cumprod() for x in (ODD, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def _deeper(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Buckets at up to twice the depth."""
    return _mixed(here * LATER + later)


class Buckets:
    """Buckets of the places of one piece of a text."""

    powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, x: np.ndarray):
        n = len(x)
        if Buckets.powers is None or len(Buckets.powers[0]) < n:
            Buckets.powers = _powers(max(n, 1 << 16))
        up, down = Buckets.powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[x] * up[:n], out=self.sums[1:])
        self.grams = _mixed((self.sums[Q:] - self.sums[:-Q]) * down[: n - Q + 1])
        self.core, depth = self.grams, Q
        while depth < CORE:
            self.core, depth = _deeper(self.core[:-depth], self.core[depth:]), 2 * depth

    def _named(self, first: np.ndarray, size: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of runs as a whole a hash, which shares nothing with the buckets, and their places in the text: first string, strings, bytes from there to the run's place."""
        whole = (self.sums[first + size - 1 + SPAN] - self.sums[first]) * Buckets.powers[1][first]
        shape = (size - 1 << 8 | back).astype(np.uint64)
        return _mixed(whole + shape * MIX), first << 16 | size - 1 << 8 | back

    def runs(self) -> tuple[np.ndarray, ...]:
        """bucket, hash, place of every run."""
        a = self.grams & ~np.uint64((1 << BITS) - 1) | np.arange(len(self.grams), dtype=np.uint64)
        strings, rows = len(self.core) - CORE, -(-len(a) // WINDOW)
        blocks = np.full(rows * WINDOW, np.iinfo(np.uint64).max)
        blocks[: len(a)] = a
        blocks = blocks.reshape(rows, WINDOW)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:strings], ahead[WINDOW - 1 : WINDOW - 1 + strings]) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        under = place[first]
        return self.core[under], *self._named(first, np.diff(np.append(first, strings)), under - first)

    def shorter(self, place: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
        """The same of runs cut in shorter ones, of at most `step` strings: those whose bytes to the run's place have one quotient by step. The last value says which run each comes from."""
        first, size, back = place >> 16, (place >> 8 & 255) + 1, place & 255
        low = (back - size + 1) // step
        parts = back // step - low + 1
        of = np.repeat(np.arange(len(place)), parts)
        part = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        far, near = np.minimum(back[of], part * step + step - 1), np.maximum((back - size + 1)[of], part * step)
        under = (first + back)[of]
        core = under - part * step
        bucket = _deeper(self.core[core], self.core[core + SPAN - step + 1 - CORE])
        return bucket, *self._named(under - far, far - near + 1, far), of


def pieces(data: bytes) -> Iterator[tuple[int, int, Buckets]]:
    """The text's pieces, the first string of each and that of the next one."""
    x = np.frombuffer(data, np.uint8)
    for at in range(0, len(x) - SPAN + 1, PIECE):
        yield at, at + PIECE, Buckets(x[at : at + PIECE + SPAN - 1])


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text, m): each text of SPAN bytes or more once, with its number; a table in buckets by (k1, k2)."""
    spark = docs.sparkSession
    text = docs.select(text_of(text_col).alias("text")).where(F.octet_length("text") >= SPAN)
    rows = text.select(*_keys("text"), "text").groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m"))
    name = f"shapelab_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "k1", "k2").format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def _keys(text: str) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def _arrays(cols: list, rows: list[int]) -> list[pa.Array]:
    """List columns of so many values a row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(rows)]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).view(pa.int64())) for c in cols]


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: k1, k2, w, text. A row for each text, its runs in arrays."""
    for batch in batches:
        g, f, place, rows = [], [], [], []
        for text in batch.column(3):
            own = [(*b.runs(), at) for at, _, b in pieces(text.as_buffer().to_pybytes())]
            g += [r[0] for r in own]
            f += [r[1] for r in own]
            place += [r[2] + (r[3] << 16) for r in own]
            rows.append(sum(len(r[0]) for r in own))
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _arrays([[np.full(n, w.as_py()) for n, w in zip(rows, batch.column(2), strict=True)]], rows)[0], *_arrays([g, f, place], rows)], ["k1", "k2", "w", "g", "f", "place"])


def _shorter_runs(step: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: k1, k2, text, runs (place, w). A row for each text, shorter runs in arrays."""
        for batch in batches:
            w, g, f, place, rows = [], [], [], [], []
            for text, runs in zip(batch.column(2), batch.column(3), strict=True):
                wanted, weight = (runs.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                first, n = wanted >> 16, 0
                for at, end, b in pieces(text.as_buffer().to_pybytes()):
                    own = np.flatnonzero((first >= at) & (first < end))
                    if len(own):
                        a, c, d, of = b.shorter(wanted[own] - (at << 16), step)
                        w.append(weight[own][of])
                        g.append(a)
                        f.append(c)
                        place.append(d + (at << 16))
                        n += len(of)
                rows.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_arrays([w, g, f, place], rows)], ["k1", "k2", "w", "g", "f", "place"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text. Columns: k1, k2, text, marks (places of runs)."""
    for batch in batches:
        out = []
        for k1, k2, text, marks in zip(*batch.columns, strict=True):
            data = text.as_buffer().to_pybytes()
            m = marks.values.to_numpy(zero_copy_only=False)
            s, n = m >> 16, (m >> 8 & 255) + 1
            edges = np.zeros(len(data) + 1, np.int64)
            np.add.at(edges, s, 1)
            np.add.at(edges, s + n - 1 + SPAN, -1)
            gone = np.cumsum(edges)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((k1.as_py(), k2.as_py(), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


RUNS = "k1 long, k2 long, w array<long>, g array<long>, f array<long>, place array<long>"


def _settled(runs: DataFrame) -> DataFrame:
    """(k1, k2, w, place, alone, again): runs that repeat, as a whole (not alone) or perhaps in part. again: to be looked at once more.

    runs: a row for each text, RUNS. w: 2 for a run that stands for several, of which none is marked."""
    each = runs.select("k1", "k2", F.explode(F.arrays_zip("w", "g", "f", "place")).alias("r")).select("k1", "k2", "r.*")
    classes = written(each.groupBy("g", "f").agg(F.sum("w").alias("c"), F.min("k1").alias("one")))
    shared = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.max("c").alias("most")).where("classes > 1 or most > 1")
    live = written(classes.join(shared.select("g", (F.col("classes") > 1).alias("contested")), "g").select(F.col("g").alias("g2"), "f", "c", "one", "contested"))
    hot = hot_of(live.where("c > 1").select("f", F.col("c").alias("n")), "f", classes.count())
    met = spread_join(each, live, "f", hot).where("g = g2")
    alone, first = F.col("c") == 1, F.col("k1") == F.col("one")
    return written(met.select("k1", "k2", "w", "place", alone.alias("alone"), (F.col("contested") & (alone | first)).alias("again")).where("(w = 1 and not alone) or again"))


def marked(texts: DataFrame) -> DataFrame:
    """(k1, k2, marks): of texts that occur once, the places of runs whose strings repeat. texts: of `distinct_texts`."""
    runs = written(texts.select("k1", "k2", F.least("m", F.lit(2)).cast("long"), "text").mapInArrow(_text_runs, RUNS))
    marks = None
    for step in (*STEPS, None):
        met = _settled(runs)
        found = met.where("w = 1 and not alone").select("k1", "k2", "place")
        marks = found if marks is None else marks.unionByName(found)
        if step:
            ask = met.where("again").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", F.when(F.col("alone"), 1).otherwise(2).alias("w"))).alias("runs"))
            runs = written(texts.select("k1", "k2", "text").join(ask.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_shorter_runs(step), RUNS))
    return marks.groupBy("k1", "k2").agg(F.collect_list("place").alias("marks"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_bytes, n_removed, n_spans, kept_sha256.

    A null or short text keeps all of its bytes. Equal texts, rows with one id among them, are repeats of each other: from SPAN bytes on
    nothing of them is left. Bytes are removed wherever they are covered, so that what is left need not be UTF-8."""
    texts = distinct_texts(docs, text_col)
    left = texts.select("k1", "k2", "text").join(marked(texts).hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "marks")
    once = left.mapInArrow(_kept, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
    nothing = hashlib.sha256().hexdigest()
    copies = texts.where("m > 1").select("k1", "k2", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
    key = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))
    changed = once.unionByName(copies).select(key.alias("k"), F.col("n_removed").alias("_removed"), F.col("n_spans").alias("_spans"), F.col("kept_sha256").alias("_kept"))
    own = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    own = own.select("_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *_keys("text")).select("_id", "n_bytes", "sha", key.alias("k"))
    counts = texts.where("m > 1").select(key.alias("k"), F.col("m").alias("n"))
    out = spread_join(own, changed, "k", hot_of(counts, "k", docs.count()), "left")
    n = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("_removed", "n_removed"), ("_spans", "n_spans"))]
    return out.select(F.col("_id").alias(id_col), "n_bytes", *n, F.coalesce("_kept", "sha").alias("kept_sha256"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
