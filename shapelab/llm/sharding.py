"""Sharding by balanced label propagation.

Rows with equal texts are a group; groups that share a line of LINE characters or more are linked, a line that many
rows hold all the more weakly. A group is a unit; one that is larger than a part of a shard is several. Units start
in shards by their hash. In each round every unit wants the shard where most of what it is linked with is; moves between
two shards are granted in equal numbers both ways (capacity quotas), those with the largest gain first, until none is
granted or ROUNDS are over. What propagation leaves is the placement: at the end a shard with too many rows gives as
many as it has too much to shards that have too few, unlinked single rows first, so that counts are at most one apart.

Neighbours are counted through the lines' counts by shard, never as pairs. Lines and groups that very many rows
have are dealt over several tasks; ranks come from counts by class and slice, so nothing is ordered in one task.

Defined results: a null text has size 1 and the group of the empty text; rows are placed one by one, repeated
rows too; a null doc_id is placed like any other; a very long text is as many lines as it has; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.operators.skew import KEYS, hot_keys, hot_of, spread_join
from shapelab.session import cut

from .common import documents, text_of

SHARDS, ROUNDS = 16, 6
#: Characters of a line that links.
LINE = 20
#: Units of a full shard at least, rows of a unit if it can, and parts of the order of a shard.
UNITS, PART, SLICES = 4, 20_000, 256


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group g of equal texts."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    return d.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.xxhash64(text_of("text")).alias("g"))


def units(nodes: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """nodes with the unit u of each row; and units (u, g, n, shard), those of one group in as few shards as hold them.

    Groups of more than a UNITS-th of a shard are split; fewer than UNITS * shards, or KEYS, of them can be that large."""
    total = nodes.count()
    most = max(1, min(total // (UNITS * shards), max(PART, total // KEYS)))
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = F.broadcast(cut(sizes.where(F.col("n") > most).select("g", F.ceil(F.col("n") / most).cast("int").alias("parts"))))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts"))).otherwise(0).cast("int")
    rows = nodes.join(large, "g", "left").withColumn("part", part).withColumn("u", F.xxhash64("g", "part"))
    start = F.pmod(F.xxhash64("g", F.lit(3)) + F.floor(F.col("part") / UNITS), F.lit(shards)).cast("int")
    found = rows.groupBy("u", "g", "part").agg(F.count(F.lit(1)).alias("n")).select("u", "g", "n", start.alias("shard"))
    return rows.drop("parts", "part", "g"), cut(found)


def links(docs: DataFrame, state: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, f, w): lines f that units of different groups share, each with the weight of one row that holds it."""
    line = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= LINE)
    lines = docs.select(text_of(text_col).alias("text")).select(F.xxhash64("text").alias("g"), F.explode(F.array_distinct(F.transform(line, lambda x: F.xxhash64(x)))).alias("f")).distinct()
    shared = cut(lines.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = shared.agg(F.sum("n")).first()[0] or 0
    pairs = cut(spread_join(lines, shared.select("f"), "f", hot_of(shared, "f", rows) if rows else None))
    sized = cut(spread_join(pairs, state.select("g", "u", "n"), "g", hot_keys(pairs, "g")))
    weight = sized.groupBy("f").agg((F.lit(1.0) / F.sum("n")).alias("w"))
    return cut(spread_join(sized.select("u", "f"), weight, "f", hot_keys(sized, "f")))


def votes(state: DataFrame, linked: DataFrame, shards: int, hot_u: DataFrame | None, hot_f: DataFrame | None) -> DataFrame:
    """(u, votes): of each linked unit, the weight of its neighbours in each shard; the unit itself is none."""
    each = spread_join(linked, state.select("u", "n", "shard"), "u", hot_u)
    by_line = each.groupBy("f").agg(*[F.sum(F.when(F.col("shard") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(shards)])
    counted = spread_join(each, by_line, "f", hot_f)
    own = lambda k: F.when(F.col("shard") == k, F.col("n")).otherwise(0)
    sums = counted.groupBy("u").agg(*[F.sum((F.col(f"n{k}") - own(k)) * F.col("w")).alias(f"v{k}") for k in range(shards)])
    return sums.select("u", F.array(*[f"v{k}" for k in range(shards)]).alias("votes"))


def propagated(state: DataFrame, linked: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """state (u, n, shard) after the rounds."""
    state = state.select("u", "n", "shard")
    hot_u, hot_f = hot_keys(linked, "u"), hot_keys(linked, "f")
    room = total / shards
    for _ in range(rounds):
        best = F.array_position("votes", F.array_max("votes")).cast("int") - 1
        wish = votes(state, linked, shards, hot_u, hot_f).join(state, "u").withColumn("to", best).where("to <> shard")
        wish = wish.select("u", "n", "shard", "to", (F.get("votes", F.col("to")) - F.get("votes", F.col("shard"))).alias("gain")).where("gain > 1e-9")
        klass = F.floor(F.log2(F.col("gain") * 1024 + 1)).cast("int")
        wish = cut(wish.withColumn("klass", klass).withColumn("slice", F.pmod(F.xxhash64("u", F.lit(5)), F.lit(SLICES))))
        if wish.isEmpty():
            break
        # quotas between two shards are even both ways; the free room of the wanted shard comes on top
        asked = wish.groupBy("shard", "to").agg(F.sum("n").alias("asked"))
        back = asked.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("asked").alias("back"))
        loads = state.groupBy("shard").agg(F.sum("n").alias("load")).select(F.col("shard").alias("to"), (F.greatest(F.lit(room) - F.col("load"), F.lit(0)) / shards).alias("free"))
        quota = asked.join(back, ["shard", "to"], "left").join(loads, "to", "left").select("shard", "to", (F.least("asked", F.coalesce("back", F.lit(0))) + F.ceil(F.coalesce("free", F.lit(room / shards)))).alias("quota"))
        # largest gains first: counts before a wish by gain class, then by slice, then inside the slice. The quotas, a
        # row per pair of shards, are joined with the counts, so that wishes meet by (shard, to, klass, slice) alone
        cells = wish.groupBy("shard", "to", "klass", "slice").agg(F.sum("n").alias("cell"))
        cells = cells.withColumn("before", F.sum("cell").over(Window.partitionBy("shard", "to").orderBy(F.desc("klass"), "slice")) - F.col("cell")).drop("cell")
        cells = cells.join(F.broadcast(quota), ["shard", "to"])
        inside = Window.partitionBy("shard", "to", "klass", "slice").orderBy("u")
        ranked = wish.withColumn("inner", F.sum("n").over(inside)).join(cells, ["shard", "to", "klass", "slice"])
        moves = cut(ranked.where("before + inner <= quota").select("u", "to"))
        if moves.isEmpty():
            break
        state = cut(state.join(moves, "u", "left").select("u", "n", F.coalesce("to", "shard").alias("shard")))
    return state


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    nodes = cut(described(docs, id_col, text_col))
    rows, state = units(nodes, shards)
    total = nodes.count()
    linked = links(docs, state, text_col)
    state = propagated(state, linked, total, shards, rounds)
    # who goes first where a shard has too many: single rows without links, then other single rows, then groups
    tied = linked.select("u").distinct().withColumn("tied", F.lit(1))
    order = F.when(F.col("n") > 1, 2).otherwise(F.coalesce("tied", F.lit(0)))
    state = cut(state.join(tied, "u", "left").select("u", "n", "shard", order.alias("klass"), F.pmod(F.xxhash64("u", F.lit(5)), F.lit(SLICES)).alias("slice")))
    loads = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("n")).collect()}  # a row per shard
    least, more = divmod(total, shards)
    fullest = sorted(loads, key=lambda s: (-loads[s], s))[:more]
    want = {s: least + (s in fullest) for s in loads}
    surplus, give, take = {}, 0, 0
    gaps = []
    for s in range(shards):
        over = loads[s] - want[s]
        surplus[s] = (max(over, 0), give)
        give += max(over, 0)
        if over < 0:
            gaps.append((take, take - over, s, loads[s]))
            take -= over
    spark = docs.sparkSession
    over = F.broadcast(spark.createDataFrame([(s, *surplus[s]) for s in surplus], "shard int, over long, first long"))
    gap = F.broadcast(spark.createDataFrame(gaps or [(-1, -1, 0, 0)], "lo long, hi long, target int, has long"))
    cells = state.groupBy("shard", "klass", "slice").agg(F.sum("n").alias("cell"))
    cells = cells.withColumn("outer", F.sum("cell").over(Window.partitionBy("shard").orderBy("klass", "slice")) - F.col("cell")).drop("cell")  # at most 3 x SLICES rows a shard
    inside = Window.partitionBy("shard", "klass", "slice").orderBy("u")
    placed = state.withColumn("inner", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(cells), ["shard", "klass", "slice"]).select("u", "shard", (F.col("outer") + F.col("inner")).alias("before"))
    within = F.row_number().over(Window.partitionBy("u").orderBy("doc_id", "text_crc32")) - 1
    ranked = rows.withColumn("within", within).join(placed, "u").withColumn("rank", F.col("before") + F.col("within")).join(over, "shard")
    goes = F.when(F.col("rank") < F.col("over"), F.col("first") + F.col("rank"))
    moved = ranked.withColumn("goes", goes).join(gap, (F.col("goes") >= F.col("lo")) & (F.col("goes") < F.col("hi")), "left")
    shard = F.coalesce("target", "shard")
    slot = F.when(F.col("target").isNotNull(), F.col("has") + F.col("goes") - F.col("lo")).otherwise(F.col("rank") - F.col("over"))
    return moved.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
