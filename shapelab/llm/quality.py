"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own and its neighbours' features; forward-backward marginals,
weighted by the lines' lengths, give the document's quality, which a two-parameter logistic curve maps to a
probability. The model is fitted on a bounded sample of labelled rows: SAMPLE documents that are not held
out, of at most LINES lines each, whose lines all take the document's label.

Defined results: null or empty texts are one empty line and are scored like any other; without labelled
rows every score is 0.5; repeated rows get equal scores; labels given twice count once (the smaller); a very long text
is scored over all its lines, though texts of more than LINES lines are no part of the sample; an empty table has no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, small_batches, text_of

#: Bounds of the training sample: documents, and lines of a document.
SAMPLE, LINES = 6000, 400
STEPS, RATE, PENALTY = 400, 0.15, 1e-3
FEATURES = 12
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _OTHER = range(6)


@lru_cache
def _classes() -> np.ndarray:
    out = np.full(0x10000, _OTHER, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            out[c] = _UPPER
        elif kind[0] in "LM":
            out[c] = _LETTER
        elif kind[0] == "N":
            out[c] = _DIGIT
        elif kind[0] == "Z" or 9 <= c <= 13:
            out[c] = _SPACE
        elif chr(c) in ".,;:'\"()-?":
            out[c] = _STOP
    return out


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line, with those of the line before and after beside them, and the lines' lengths."""
    lines = text.split("\n")
    cp = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[np.minimum(cp, 0xFFFF)]
    starts = np.concatenate([[0], np.flatnonzero(cp == 10)[:-1] + 1])
    sums = np.stack([np.add.reduceat((kind == k).astype(np.int64), starts) for k in range(6)], axis=1).astype(float)
    length = np.array([len(x) for x in lines], float)
    n = np.maximum(length, 1)
    letters = np.maximum(sums[:, _LETTER] + sums[:, _UPPER], 1)
    x = np.empty((len(lines), FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.minimum(10 * sums[:, _OTHER] / n, 3)
    x[:, 2] = sums[:, _UPPER] / letters
    x[:, 3] = sums[:, _DIGIT] / n
    x[:, 4] = np.minimum(10 * sums[:, _STOP] / n, 3)
    x[:, 5] = np.log1p(length) / 5
    for i, line in enumerate(lines):
        words = line.split()
        k = max(len(words), 1)
        x[i, 6] = sum(map(str.__eq__, words, words[1:])) / k
        x[i, 7] = 1 - len(set(words)) / k if words else 0
        x[i, 8] = min(5 * line.count("|") / k, 3)
        x[i, 9] = min(line.count("!") / k, 3)
        x[i, 10] = k < 4
        x[i, 11] = min((length[i] - k + 1) / k / 6, 3)
    around = np.zeros((len(lines), 2 * (FEATURES - 1)))
    around[1:, : FEATURES - 1] = x[:-1, 1:]
    around[:-1, FEATURES - 1 :] = x[1:, 1:]
    return np.concatenate([x, around], axis=1), length


WIDTH = FEATURES + 2 * (FEATURES - 1)


def marginals(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability that each line is good. score: log potential of good against bad; move: [[bad bad, bad good], [good bad, good good]]."""
    stay0, up, down, stay1 = np.exp(move - move.max()).ravel().tolist()
    pot = np.exp(np.clip(score, -30, 30)).tolist()
    n = len(pot)
    forward = [0.0] * n
    a, b = 1.0, pot[0]
    forward[0] = b / (a + b)
    for t in range(1, n):
        g = forward[t - 1]
        a, b = (1 - g) * stay0 + g * down, ((1 - g) * up + g * stay1) * pot[t]
        forward[t] = b / (a + b)
    out = np.empty(n)
    b0 = b1 = 0.5
    for t in range(n - 1, -1, -1):
        g = forward[t]
        p, q = g * b1, (1 - g) * b0
        out[t] = p / (p + q) if p + q else g
        c1 = pot[t] * b1
        b0, b1 = stay0 * b0 + up * c1, down * b0 + stay1 * c1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    return out


def document_quality(text: str, model: dict) -> float:
    """The mean of the lines' marginals, each weighted by its length and one."""
    x, length = line_features(text)
    p = marginals(x @ model["w"], model["move"])
    return float(np.average(p, weights=length + 1))


def calibrated(quality: float, model: dict) -> float:
    q = min(max(quality, 1e-6), 1 - 1e-6)
    a, b = model["curve"]
    return float(1 / (1 + np.exp(-np.clip(a * np.log(q / (1 - q)) + b, -30, 30))))


def _log_partition(s: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of log Z over chains (padded, time first), and its derivatives by scores and moves."""
    T, n = s.shape
    pot = np.stack([np.zeros_like(s), s], axis=2)
    alpha = np.empty((T, n, 2))
    alpha[0] = pot[0]
    for t in range(1, T):
        step = np.logaddexp(alpha[t - 1][:, :1] + move[0], alpha[t - 1][:, 1:] + move[1]) + pot[t]
        alpha[t] = np.where(mask[t][:, None], step, alpha[t - 1])
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    beta = np.zeros((n, 2))
    ds, dm = np.zeros_like(s), np.zeros((2, 2))
    for t in range(T - 1, -1, -1):
        ds[t] = np.exp(alpha[t][:, 1] + beta[:, 1] - z) * mask[t]
        if t:
            inner = pot[t] + beta
            joint = alpha[t - 1][:, :, None] + move[None] + inner[:, None, :] - z[:, None, None]
            dm += (np.exp(joint) * mask[t][:, None, None]).sum(axis=0)
            back = np.logaddexp(move[:, 0][None] + inner[:, :1], move[:, 1][None] + inner[:, 1:])
            beta = np.where(mask[t][:, None], back, beta)
    return float(z.sum()), ds, dm


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """Conditional likelihood of the chains by Adam, then the curve from document quality to probability."""
    model = {"w": np.zeros(WIDTH), "move": np.zeros((2, 2)), "curve": (1.0, 0.0)}
    if not rows:
        return model
    rows = sorted(rows, key=lambda r: len(r[0]))
    good = np.mean([r[2] for r in rows])
    share = {1: 0.5 / max(good, 0.02), 0: 0.5 / max(1 - good, 0.02)}
    groups = []
    for i in range(0, len(rows), 500):  # chains of about the same length side by side
        part = rows[i : i + 500]
        T = max(len(r[0]) for r in part)
        x = np.zeros((T, len(part), WIDTH), np.float32)
        mask = np.zeros((T, len(part)), bool)
        for k, (f, _, _) in enumerate(part):
            x[: len(f), k], mask[: len(f), k] = f, True
        groups.append((x, mask, np.array([r[2] for r in part])))
    w, move = model["w"], model["move"]
    m = v = np.zeros(WIDTH + 4)
    rng = np.random.Generator(np.random.Philox(2))
    for step in range(1, STEPS + 1):
        x, mask, y = groups[rng.integers(len(groups))]
        weight = np.where(y == 1, share[1], share[0])
        s = (x @ w.astype(np.float32)).astype(float)
        # chains are weighted by class through the counts that the two derivatives share
        grad = np.zeros(WIDTH + 4)
        for c in (0, 1):
            of = y == c
            if of.any():
                _, ds, dm = _log_partition(s[:, of], move, mask[:, of])
                pairs = mask[1:, of].sum()
                ds = (ds - mask[:, of] * c) / mask[:, of].sum()
                dm[c, c] -= pairs
                grad[:WIDTH] += weight[of][0] * of.mean() * np.tensordot(ds, x[:, of].astype(float), axes=((0, 1), (0, 1)))
                grad[WIDTH:] += weight[of][0] * of.mean() * (dm / max(pairs, 1)).ravel()
        grad += PENALTY * np.concatenate([w, move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        d = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, move = w - d[:WIDTH], move - d[WIDTH:].reshape(2, 2)
    model["w"], model["move"] = w, np.clip(move, -3, 3)
    q = np.array([np.average(marginals(f @ model["w"], model["move"]), weights=n + 1) for f, n, _ in rows])
    q = np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    y = np.array([r[2] for r in rows], float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a penalised logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))
        r = p * (1 - p) + 1e-6
        g = np.array([((p - y) * q).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(r * q * q).sum() + 0.1, (r * q).sum()], [(r * q).sum(), r.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
        a = max(a, 0.05)
    model["curve"] = (float(a), float(b))
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits the model on a sample of labelled rows that aren't held out, drawn by a hash of doc_id."""
    docs = small_batches(docs)
    drawn = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, y, *line_features(x.as_py())) for i, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
            rows = [r for r in rows if len(r[2]) <= LINES]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary()), pa.array([r[3].astype("<f4").tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x", "n"])

    sample = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    found = sample.mapInArrow(run, "doc_id long, quality int, x binary, n binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[2])))
    return fit([(np.frombuffer(r[2], "<f4").reshape(-1, WIDTH), np.frombuffer(r[3], "<f4"), r[1]) for r in found])


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    docs = small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [calibrated(document_quality(x.as_py(), model), model) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = ids.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject."""
    docs = small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [calibrated(document_quality(x.as_py() or "", model), model) >= 0.5 for x in b.column(text_col)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
