"""Near duplicates by MinHash bands and sequential Bayesian verification.

Documents with the same words form a class; only its smallest doc_id goes on. Band keys of the MinHash
signatures give candidates. Shingles that no other candidate has can be in no intersection: they bound how
large a document's partner may be, and rule out documents that no partner can reach. Within a bucket not all
pairs are made: a document meets the bucket's pivot first, what is confirmed is merged, and members of a bucket that are still in different components meet only
where they share one of their rarest shingles (the exact prefix filter). Pairs that one component
already joins need no check, so no component is lost.
A candidate's signatures are compared batch by batch; it is pruned once the posterior probability that its
similarity reaches the threshold is below MISS. Survivors are verified on the full shingle sets.

Pairs with one document that very many others meet are dealt over several tasks (`operators/skew.py`).

Defined results: null or wordless texts have the empty set and are linked with nothing; a null doc_id gets
a null component and is kept; repeated rows get one row each; texts that share one doc_id are one document, with the
links of each of them; a text of any length is read whole, as sorted 64-bit values; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.operators.graph import components
from shapelab.operators.skew import hot_keys, hot_of, spread_join
from shapelab.session import stored

from .common import documents, free, small_batches, text_of, written

WORDS = 5
SIMILAR = (75, 100)
#: 32 bands of 4 values: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
BATCH = 32
#: A candidate is pruned if the chance that it is similar enough is below this.
MISS = 1e-6
#: Documents that have a rare shingle, at most.
RARE = 64
#: Shingles of verified documents that a task holds.
REMEMBERED = 2_000_000

_SIZE = BANDS * ROWS
_rng = np.random.Generator(np.random.Philox(20))
_A = _rng.integers(0, 2**64, _SIZE, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, _SIZE, dtype=np.uint64)
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def shingles_of(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit values of the runs of five words; a shorter sequence is one run."""
    if not words:
        return np.empty(0, np.uint64)
    seen: dict[bytes, int] = {}
    h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    x = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        x = x * _P[k] + h[k : k + n]
        x ^= x >> np.uint64(29)
    x *= _P[0]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(_SIZE, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None] * _A
        x += _B
        np.minimum(out, (x.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


@lru_cache
def least_matches(n: int) -> int:
    """The fewest of n equal values that leave a chance of MISS, with a uniform prior: P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    t, total = SIMILAR[0] / SIMILAR[1], 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, h (of the text), key (of the word sequence; null without words), n_shingles and the signature."""
    docs = small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sigs = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(x.as_py())
                s = shingles_of(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words and i is not None else None)
                sizes.append(len(s))
                sigs.append(signature(s).astype("<u4").tobytes() if keys[-1] else None)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "h", "key", "n_shingles", "sig"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h")).mapInArrow(run, "doc_id long, h long, key binary, n_shingles long, sig binary")


def _pruned(pairs: DataFrame, sigs: DataFrame, hot: dict[str, DataFrame | None]) -> DataFrame:
    """Candidates (a, b) that the signatures leave."""
    pairs = small_batches(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array([np.frombuffer(v, "<u4") for v in b.column(k).to_pylist()], np.uint32).reshape(-1, _SIZE) for k in (2, 3))
            alive, same = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n in range(BATCH, _SIZE + 1, BATCH):
                same = same + (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                ok = same >= least_matches(n)
                alive, same = alive[ok], same[ok]
            yield pa.record_batch([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive))], ["a", "b"])

    of = lambda k: sigs.select(F.col("doc_id").alias(k), F.col("sig").alias(f"sig_{k}"))
    both = spread_join(spread_join(pairs, of("a"), "a", hot["a"]), of("b"), "b", hot["b"])
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, hot: dict[str, DataFrame | None]) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    pairs = small_batches(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        held = [0]

        def of(i: int, text: pa.Scalar) -> np.ndarray:
            if i not in kept:
                kept[i] = shingles_of(words_of(text.as_py()))
                held[0] += len(kept[i])
                if held[0] > REMEMBERED:
                    one = kept.pop(i)
                    kept.clear()
                    kept[i], held[0] = one, len(one)
            return kept[i]

        for b in batches:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            ok = [similar(of(i, x), of(j, y)) for (i, j), x, y in zip(ids, b.column(2), b.column(3))]
            yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    of = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = spread_join(spread_join(pairs, of("a"), "a", hot["a"]), of("b"), "b", hot["b"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, shingle) of every shingle of every text."""
    texts = small_batches(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles_of(words_of(x.as_py())).view(np.int64) for x in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets), pa.int64())], ["doc_id", "shingle"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle long")


def _unique_counts(texts: DataFrame) -> DataFrame:
    """(doc_id, own): how many shingles of a document no other document of `texts` has."""
    once = _shingle_rows(texts).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))


def _across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can be similar.

    rest: doc_id, c, size, widest, smallest (no partner is smaller, so `common` shingles at least must be shared).
    Shingles of one component alone are in no such pair. Of the others, a pair shares no more frequent ones than
    the one of its documents has that has fewer; what that lacks must be rare ones. So a pair shares one of the
    first `rare - lack + 1` rare shingles of both its documents, or both have enough frequent ones, and share one
    of the first `often - common + 1` of those (the prefix filter, twice). A rare shingle makes at most RARE pairs
    for each document that has it."""
    least, whole = SIMILAR
    docs = stored(rest.groupBy("doc_id", "c", "size", "widest").agg(F.min("smallest").alias("smallest")))
    rows = stored(_shingle_rows(texts.join(docs.select("doc_id"), "doc_id", "left_semi")).join(docs.select("doc_id", "c"), "doc_id"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle", "n")
    shared = stored(shared)
    rows = spread_join(rows, shared, "shingle", hot_of(shared, "shingle", rows.count())).withColumn("rare", F.col("n") <= RARE)
    own = Window.partitionBy("doc_id")
    often = F.sum(F.when(F.col("rare"), 0).otherwise(1)).over(own)
    place = F.row_number().over(Window.partitionBy("doc_id", "rare").orderBy("n", "shingle"))
    common = F.ceil((F.col("size") + F.col("smallest")) * least / (least + whole))
    rows = rows.join(docs.drop("c"), "doc_id").withColumn("often", often).withColumn("some", F.count(F.lit(1)).over(own) - F.col("often")).withColumn("place", place).withColumn("common", common)
    lack = F.greatest(F.col("common") - F.col("often"), F.lit(1))
    last = F.when(F.col("rare"), F.col("some") - lack + 1).otherwise(F.col("often") - F.col("common") + 1)
    rows = stored(rows.where(F.col("place") <= last).select("shingle", "doc_id", "c", "size", "widest", "rare", "place", "often", "some"))
    x, y = (rows.select("shingle", *[F.col(v).alias(f"{v}_{k}") for v in rows.columns[1:]]) for k in ("a", "b"))
    # the same bounds with what this pair must have in common
    both = F.ceil((F.col("size_a") + F.col("size_b")) * least / (least + whole))
    lacks = F.greatest(both - F.least("often_a", "often_b"), F.lit(1))
    ends = [F.col(f"place_{k}") <= F.when(F.col("rare_a"), F.col(f"some_{k}") - lacks).otherwise(F.col(f"often_{k}") - both) + 1 for k in "ab"]
    near = (F.col("c_a") < F.col("c_b")) & (F.col("size_a") <= F.col("widest_b")) & (F.col("size_b") <= F.col("widest_a"))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & near & ends[0] & ends[1])
    return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    base = written(sketches(docs, id_col, text_col))
    classes = base.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.count(F.lit(1)).alias("n")).select("key", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_h"), "n")
    classes = stored(classes)
    hot = hot_of(classes, "key", base.count())  # many copies of one text
    classes = classes.drop("n")
    # A class is named by its smallest doc_id; where one doc_id has several texts, all but one of their classes need names of their own.
    again = stored(classes.groupBy("rep").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    many_texts = not again.isEmpty()
    if many_texts:
        named = F.when(F.col("key") == F.coalesce("first", "key"), F.col("rep")).otherwise(F.xxhash64("key"))
        classes = stored(spread_join(classes, again, "rep", hot_keys(classes, "rep"), "left").select("key", "rep", "rep_h", named.alias("node")))
    else:
        classes = classes.withColumn("node", F.col("rep"))
    sigs = base.join(classes, "key").where("doc_id = rep and h = rep_h").select(F.col("node").alias("doc_id"), "n_shingles", "sig")
    sigs = written(sigs.dropDuplicates(["doc_id"]))
    band = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {4 * ROWS * i + 1}, {4 * ROWS})")) for i in range(BANDS)])
    bands = sigs.select("doc_id", F.explode(band).alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(bands.join(buckets, "bucket").select("bucket", "doc_id", "n"))  # buckets of one are gone

    # What a document's own shingles leave bounds its partners' sizes; many have no possible partner.
    members = stored(shared.groupBy("doc_id").agg(F.sum("n").alias("weight")))
    texts = docs.select(docs[id_col].cast("long").alias("rep"), text_of(text_col).alias("text")).withColumn("rep_h", F.xxhash64("text"))
    texts = texts.join(classes.join(members, classes["node"] == members["doc_id"]).select("rep", "rep_h", "doc_id"), ["rep", "rep_h"]).select("doc_id", "text")
    texts = written(texts.dropDuplicates(["doc_id"]))
    least, whole = SIMILAR
    size = F.col("n_shingles")
    widest = F.floor((size - F.coalesce("own", F.lit(0))) * (least + whole) / least) - size
    able = sigs.select("doc_id", "n_shingles").join(members, "doc_id").join(_unique_counts(texts), "doc_id", "left").select("doc_id", size.alias("size"), widest.alias("widest"), "weight")
    able = stored(able.where(F.col("widest") * whole >= F.col("size") * least))  # a partner has at least that share of the size
    sigs = written(sigs.select("doc_id", "sig").join(able.select("doc_id"), "doc_id", "left_semi"))
    rows = shared.select("bucket", "doc_id").join(able, "doc_id")
    # A bucket's pivot is the document with the largest buckets: that from which a group of copies was made, or one like it.
    pivots = rows.groupBy("bucket").agg(F.max(F.struct("weight", "doc_id", "size", "widest")).alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("size").alias("smallest")).where("n > 1").drop("n")
    shared = stored(rows.join(pivots, "bucket").where("smallest <= widest").select("bucket", "doc_id", "size", "widest", "smallest", "pivot"))
    labels = None

    def merged(pairs: DataFrame) -> None:
        pairs = stored(pairs)
        hot = {k: hot_keys(pairs, k) for k in "ab"}
        linked(stored(_confirmed(_pruned(pairs, sigs, hot), texts, hot)))

    def linked(links: DataFrame) -> None:
        nonlocal labels
        if links.isEmpty():
            return
        if labels is None:
            labels = components(links, "a", "b")
            return
        c = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
        ends = links.join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("c_a", "a").alias("u"), F.coalesce("c_b", "b").alias("v"))
        over = components(ends).select(F.col("node").alias("component"), F.col("component").alias("least"))
        known = labels.unionByName(over.select(F.col("component").alias("node"), "component")).distinct()
        labels = stored(known.join(over, "component", "left").groupBy("node").agg(F.min(F.coalesce("least", "component")).alias("component")))

    def apart() -> DataFrame:
        """Rows of the buckets that still hold more than one component."""
        x = shared.withColumn("c", F.col("doc_id"))
        if labels is not None:
            x = shared.join(labels, shared["doc_id"] == labels["node"], "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component")
        mixed = x.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
        return stored(x.join(mixed, "bucket"))

    fits = "pivot.doc_id <> doc_id and pivot.size <= widest and size <= pivot.widest"
    # Each document meets the one pivot that comes first in order.
    merged(shared.where(fits).groupBy("doc_id").agg(F.max("pivot").alias("pivot")).select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")))
    # Then the pivots of all its buckets that are in other components.
    rest = apart()
    at = rest.select(F.col("doc_id").alias("b"), F.col("c").alias("c_b")).distinct()
    firsts = rest.where(fits).select(F.col("doc_id").alias("a"), "c", F.col("pivot.doc_id").alias("b")).distinct()
    merged(firsts.join(at, "b").where("c <> c_b").select("a", "b"))
    # Then whatever a bucket still holds in different components, exactly.
    merged(_across(apart(), texts))

    if many_texts:
        linked(classes.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    if labels is None:
        known = classes.select("key", F.col("rep").alias("component_id"))
    else:
        known = stored(classes.join(labels, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component_id")))
        if many_texts:  # a name that is no doc_id may be the smallest
            least_id = known.groupBy("component_id").agg(F.min("rep").alias("least_id"))
            known = spread_join(known, least_id, "component_id", hot_keys(known, "component_id")).select("key", F.col("least_id").alias("component_id"))
        known = known.select("key", "component_id")
    rows = base.select("doc_id", "key", "n_shingles")
    out = spread_join(rows.where("key is not null"), known, "key", hot)
    out = out.unionByName(rows.where("key is null").withColumn("component_id", F.lit(None).cast("long")))  # without words: linked with nothing
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept; of rows with one doc_id, one (the smallest text hash). Rows without an id stay."""
    own, again = free(docs, "_kept"), free(docs, "_again")
    kept = near_duplicates(docs, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    with_id = docs.join(kept, F.col(id_col).cast("long") == F.col(own), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_of(text_col)))
    once = with_id.withColumn(again, F.row_number().over(order)).where(F.col(again) == 1).drop(again)
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
