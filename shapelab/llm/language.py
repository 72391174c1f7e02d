"""Language by words first, backing off to shorter and shorter character n-grams.

A known word is scored by the logarithm of its frequency in each language. An unseen word is scored by its
longest known n-grams, of LONGEST characters first, then one less, and so on; characters that are never seen
score alike everywhere. The model is fitted on at most SAMPLE documents of each language that may be learned from,
drawn by a hash; all their words and n-grams are counted, and those seen MIN_COUNT times are known.

Defined results: a null text, or one without a letter, is `und` with score 1; without anything to learn from,
every text is `und` with score 0; ties take the language that sorts first; repeated rows are learned once and get equal
results; a very long text is read whole; an empty table has no rows. Letters and marks make words, in training as in
scoring. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.session import cut

from .common import documents, held_out, small, small_batches, text_of

LONGEST = 4
MIN_COUNT = 3
#: Documents of a language that are learned from, at most.
SAMPLE = 2000
UNKNOWN = "und"
#: Drawn documents that are sent to every executor at most; more are joined by key.
BROADCAST_ROWS = 100_000


@lru_cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """A run of letters and marks, and a letter."""

    def runs(kinds: str) -> str:
        out, first = [], None
        for c in range(0x110000 + 1):
            of = c < 0x110000 and unicodedata.category(chr(c))[0] in kinds
            if of and first is None:
                first = c
            elif not of and first is not None:
                out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
                first = None
        return "".join(out)

    return re.compile(f"[{runs('LM')}]+"), re.compile(f"[{runs('L')}]")


def learnable(docs: DataFrame) -> DataFrame:
    """(lang, text) of the documents that are learned from."""
    d = docs.where("text is not null and lang is not null").where(~held_out()).select("lang", F.lower("text").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    # a share of each language by its count, of about twice as many, comes before the rank: no language is ranked whole
    n = small(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), BROADCAST_ROWS)
    share = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    near = d.select("lang", "h").join(n, "lang").where(share * F.col("n") < 2.0 * SAMPLE).select("lang", "h").distinct()
    drawn = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= SAMPLE)
    drawn = small(drawn.select("lang", "h"), BROADCAST_ROWS)
    return d.join(drawn, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame) -> dict:
    """Counts of words and of n-grams by language."""
    words = learnable(docs).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("key"))
    counts = cut(words.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")))
    marked = counts.select("lang", "n", F.concat(F.lit("<"), "key", F.lit(">")).alias("w"))
    places = marked.select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    cuts = F.array(*[F.when(F.col("i") + k - 1 <= F.length("w"), F.substr("w", F.col("i"), F.lit(k))) for k in range(1, LONGEST + 1)])
    grams = places.select("lang", "n", F.explode(cuts).alias("key")).where("key is not null")
    grams = cut(grams.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    model: dict = {"langs": langs, "words": {}, "grams": {}}
    if not langs:
        return model

    def logs(rows: DataFrame) -> dict[str, np.ndarray]:
        share = [F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)).alias(f"n{i}") for i, g in enumerate(langs)]
        table = cut(rows.groupBy("key").agg(F.sum("n").alias("all"), *share))
        total = np.array(table.agg(*[F.sum(f"n{i}") for i in range(len(langs))]).first(), float)
        known = sorted(tuple(r) for r in table.where(F.col("all") >= MIN_COUNT).drop("all").collect())  # of a sample that is bounded
        return {r[0]: np.log((np.array(r[1:], float) + 0.5) / (total + 500)).astype(np.float32) for r in known}

    model["words"] = logs(counts)
    for k in range(1, LONGEST + 1):
        model["grams"] |= logs(grams.where(F.length("key") == k))
    return model


class Scorer:
    """Scores of known words and n-grams are rows of two matrices; a text picks its rows and adds them up."""

    def __init__(self, model: dict) -> None:
        self.langs = model["langs"]
        width = len(self.langs)

        def rows(table: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
            m = np.array(list(table.values()), np.float64).reshape(len(table), width)
            return {k: i for i, k in enumerate(table)}, m - m.mean(axis=1, keepdims=True) if width else m

        self.word, self.word_rows = rows(model["words"])
        self.gram, self.gram_rows = rows(model["grams"])

    def _grams(self, word: str) -> list[int]:
        """Backoff of an unseen word: at each of its places the longest known n-gram."""
        marked, gram, out = f"<{word}>", self.gram, []
        for at in range(len(marked)):
            for n in range(LONGEST, 0, -1):
                g = gram.get(marked[at : at + n])
                if g is not None:
                    out.append(g)
                    break
        return out

    def __call__(self, text: str) -> tuple[str, float]:
        run, letter = patterns()
        if not letter.search(text):
            return UNKNOWN, 1.0
        words = run.findall(text.lower())
        if not self.langs:
            return UNKNOWN, 0.0
        known, grams, weights = [], [], []
        find = self.word.get
        for w, n in Counter(words).items():
            i = find(w)
            if i is not None:
                known += [i] * n
            else:
                own = self._grams(w)
                grams += own
                weights += [n / len(own)] * len(own) if own else []
        total = self.word_rows[known].sum(axis=0) + np.array(weights) @ self.gram_rows[np.array(grams, np.int64)]
        p = np.exp(np.clip(total - total.max(), -60, 0))
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    docs = small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            out = [score(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return ids.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predicted(docs, train(docs))
