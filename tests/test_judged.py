"""The stateful stream: sums over restarts, repeats, timers and odd rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shapelab.streaming import judged

SCHEMA = "dataset string, ts timestamp, t long, d_ab double, d_ac double, answer int"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, judged.STORE)
    yield
    spark.conf.set(key, old)


def lot(seed, n, day):
    r = random.Random(seed)
    return [(r.choice(["chairs", "lamps", "lamps"]), DAY + dt.timedelta(days=day, seconds=k), 1000 * seed + k, r.choice([0.5, r.random()]), r.choice([0.5, r.random()]), r.choice([1, 2])) for k in range(n)]


def test_sums_go_on_after_a_restart(spark, tmp_path, store):
    """Each run ends and the next begins from its checkpoint; the totals are those of a plain count."""
    first, second = lot(1, 200, 0), lot(2, 150, 0)
    odd = [("lamps", None, 1, 0.1, 0.2, 1), ("lamps", DAY, 2, None, 0.2, 1), ("lamps", DAY, 3, 0.1, 0.2, None), (None, DAY, 4, 0.2, 0.2, 1)]
    third = lot(3, 1, 9)

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = judged.judged(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle_ms=86_400_000, slots=4)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
        return spark.read.parquet(str(tmp_path / "out"))

    def plain(rows):
        out: dict = {}
        for d, ts, _, ab, ac, answer in rows:
            if None not in (ts, ab, ac, answer):
                out.setdefault(d, []).append(((1 if round(ab, 9) <= round(ac, 9) else 2) == answer, abs(ab - ac)))
        return {d: (len(x), sum(h for h, _ in x) / len(x), sum(g for _, g in x) / len(x)) for d, x in out.items()}

    def check(said, rows):
        got = {r.dataset: (r.n, r.accuracy, r.separation) for r in judged.totals(said).collect()}
        want = plain(rows)
        assert set(got) == set(want) and all(got[d] == pytest.approx(want[d]) for d in want)

    check(run(first + odd), first + odd)
    said = run(second + first[:50])  # repeats don't count
    check(said, first + odd + second)
    assert not said.where("final").count()
    check(run(third), first + odd + second + third)
    # the first day is over but for the slot that got the one row of the third lot
    said = run(lot(4, 60, 9))
    late = {(d, r.slot) for d in {x[0] for x in third} for r in spark.createDataFrame(third, SCHEMA).select(F.pmod(F.xxhash64("t"), F.lit(4)).alias("slot")).collect()}
    day = int((DAY + dt.timedelta(days=1)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    old = {(r.dataset, r.slot) for r in said.where(F.col("born") < day).collect()}
    done = {(r.dataset, r.slot): r.n for r in said.where("final").collect()}
    assert set(done) == old - late and len(late) == 1
    most = {(r.dataset, r.slot): r.n for r in said.where(F.col("born") < day).groupBy("dataset", "slot").agg(F.max("n").alias("n")).collect()}
    assert all(done[k] == most[k] for k in done)
    anew = {(r.dataset, r.slot) for r in said.where(F.col("born") >= day).collect()}
    assert anew & set(done) and not anew & late
    check(said, first + odd + second + third + lot(4, 60, 9))
