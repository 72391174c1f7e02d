"""Repair of conversations by lightest derivations.

An item says that the rows up to a place have been repaired and what the roles so far end with. Its deductions are edits:
each makes one item from another and adds to its weight, which is the pair (cost, audit), compared in that order. An
edit never makes a weight smaller and keeps the order of two weights (weights of one item with equal costs have equally
many letters, or none that begins with the other), so that Knuth's agenda is exact: the lightest item is popped, and is
final the first time; the search ends when the goal is final.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length is spread over tasks. One that
lies within a block is repaired there. The blocks of a longer one give the weights from each state to each state; those
are edges of the same agenda over groups of blocks, level by level. Only the hash of a long conversation is read by one
task, row by row: SHA-256 of one message is a chain.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators.skew import hot_of, spread_join
from shapelab.session import cut, table

from .common import CRC_SQL, crc32_sql, written

#: Rows and characters of a block, blocks that are combined at once (as a power of two), repeated texts that are sent to every task.
ROWS, CHARS, GROUP, SENT = 256, 1 << 22, 4, 50_000
BLANK, END = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; what follows an initial, and the role that a state needs.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDS = ("user", "user", "assistant", "user")
GOALS, STATES = (0, 3), range(4)
LEGAL = ("su", "ua", "au")

Row = tuple[str, str, int, str]  # role, text, copies, fault
Weight = tuple[int, str]
Edges = Callable[[int, int], Iterable[tuple[int, int, int, str]]]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones as one with their number. Null roles, texts and parts of a hash are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    role = F.when(h == 4, F.lit("user")).otherwise(one("role"))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(one("text"), "".join(END), "")).otherwise(one("text"))
    rows = turns.where(h != 0).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _seen(rows: DataFrame) -> DataFrame:
    """Adds `again`: role and text occur at an earlier turn of the conversation."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.char_length("role").cast("string"), "role", "text"), 256)
    keyed = rows.withColumn("key", key)
    counts = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1"))
    first, repeated = counts.select("key", "first"), counts.count()
    joined = keyed.join(F.broadcast(first), "key", "left") if repeated <= SENT else spread_join(keyed, first, "key", hot_of(counts, "key", rows.count()), "left")
    return joined.select("conv_id", "turn", "role", "text", "n", F.coalesce(at > F.col("first"), F.lit(False)).alias("again"))


def lightest(size: int, edges: Edges, starts: Iterable[int], goals: Iterable[int] = ()) -> dict[tuple[int, int], Weight]:
    """Weights of (start, state) at place `size`, by Knuth's agenda. With goals, the first of these states that becomes final ends it.

    edges(place, state): (next place, next state, cost, letters) of all deductions from an item."""
    agenda: list[tuple[int, str, int, int, int]] = [(0, "", 0, q, q) for q in starts]
    final, out = set(), {}
    while agenda:
        cost, audit, at, start, state = heapq.heappop(agenda)
        if (at, start, state) in final:
            continue
        final.add((at, start, state))
        if at == size:
            out[start, state] = (cost, audit)
            if state in goals:
                return {(start, state): (cost, audit)}
        for to, then, more, letters in edges(at, state):
            if (to, start, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, to, start, then))
    return out


def _row_edges(rows: list[Row]) -> Edges:
    def edges(at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        need = NEEDS[state]
        yield at, STEP[state, need[0]], INSERT, "I"
        if at < len(rows):
            role, _, n, fault = rows[at]
            yield at + 1, state, DELETE * n, "D" * n
            if fault not in ("blank", "duplicate"):
                cost, rest = CUT_OFF * (fault == "truncated") + DELETE * (n - 1), "D" * (n - 1)
                if (state, role[:1]) in STEP:
                    yield at + 1, STEP[state, role[:1]], cost, "K" + rest
                yield at + 1, STEP[state, need[0]], cost + REROLE, "R" + rest

    return edges


def _block_edges(tables: list[list]) -> Edges:
    by = [{q: [(at + 1, *e[1:]) for e in t if e[0] == q] for q in STATES} for at, t in enumerate(tables)]
    return lambda at, state: by[at][state] if at < len(by) else ()


def fault_of(role: str, text: str, again: bool) -> str:
    seen = text.rstrip(BLANK)
    return "blank" if not seen else "duplicate" if again else "" if seen.endswith(END) else "truncated"


def repaired(audit: Iterator[str], rows: Iterable[Row], state: int = 0) -> Iterator[str]:
    """`role:text` of what the edits leave. A state needs one role, so that the letters say all."""

    def inserted() -> Iterator[tuple[str, str]]:
        nonlocal state
        for c in audit:
            if c != "I":
                yield c, ""
                return
            yield c, NEEDS[state] + ":"
            state = STEP[state, NEEDS[state][0]]

    for role, text, n, _ in rows:
        for _ in range(n):
            for letter, made in inserted():
                if letter == "I":
                    yield made
                elif letter != "D":
                    kept = role if letter == "K" else NEEDS[state]
                    yield f"{kept}:{text}"
                    state = STEP[state, kept[0]]
    for _, made in inserted():
        yield made


def _sha(lines: Iterable[str]) -> str:
    h, first = hashlib.sha256(), True
    for line in lines:
        h.update(line.encode() if first else b"\n" + line.encode())
        first = False
    return h.hexdigest()


COUNTS = ("blank", "duplicate", "truncated", "illegal")
BLOCK = "conv_id long, part int, seq long, whole boolean, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, weights string, cost long, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in BLOCK.split(", ")]
TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
ARROW = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in BLOCK.split(", ")])


def _counted(turns: list[int | None], rows: list[Row]) -> dict:
    """The counts of a block."""
    known = [t for t in turns if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)) + sum(r[2] - 1 for r in rows)
    faults = {f: 0 for f in COUNTS[:3]}
    for _, _, n, fault in rows:
        if fault == "blank":
            faults["blank"] += n
        else:
            faults["duplicate"] += n - (fault != "duplicate")
            faults["truncated"] += fault == "truncated"
    return {"lo": min(known, default=None), "hi": max(known, default=None), "turns": len(set(known)), **faults, "illegal": illegal, "head": rows[0][0][:1], "tail": rows[-1][0][:1]}


def _joined(a: dict, b: dict) -> dict:
    """The counts of two neighbouring blocks."""
    return {
        "lo": b["lo"] if a["lo"] is None else a["lo"],
        "hi": a["hi"] if b["hi"] is None else b["hi"],
        "turns": a["turns"] + b["turns"] - (a["hi"] is not None and a["hi"] == b["lo"]),
        **{c: a[c] + b[c] + (c == "illegal" and a["tail"] + b["head"] not in LEGAL) for c in COUNTS},
        "head": a["head"],
        "tail": b["tail"],
    }


def _weights(w: dict[tuple[int, int], Weight]) -> str:
    return json.dumps([[a, b, *v] for (a, b), v in w.items()])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task to blocks. Its first and its last conversation may go on in other tasks, so that they are never whole."""
    part, conv, started, seq, chars = TaskContext.get().partitionId(), None, False, 0, 0
    turns: list[int | None] = []
    rows: list[Row] = []
    out: list[dict] = []
    edge = True  # the task's first conversation

    def flush(ended: bool) -> None:
        nonlocal turns, rows, seq, chars
        if rows:
            whole = ended and not edge and seq == 0
            made = {"conv_id": conv, "part": part, "seq": seq, "whole": whole, **_counted(turns, rows)}
            if whole:
                ((cost, audit),) = lightest(len(rows), _row_edges(rows), (0,), GOALS).values()
                made |= {"cost": cost, "audit": audit, "repaired_sha256": _sha(repaired(iter(audit), rows))}
            else:
                made["weights"] = _weights(lightest(len(rows), _row_edges(rows), STATES))
            out.append(made)
        turns, rows, chars, seq = [], [], 0, 0 if ended else seq + 1

    for batch in batches:
        for c, turn, role, text, n, again in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if started and c != conv:
                flush(True)
                edge = False
            conv, started = c, True
            if len(rows) >= ROWS or chars > CHARS:
                flush(False)
            turns.append(turn)
            rows.append((role, text, n, fault_of(role, text, again)))
            chars += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, ARROW)
            out = []
    edge = True
    flush(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW)


def _combined(blocks: pa.Table) -> pa.Table:
    """Neighbouring blocks of a conversation as one."""
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    total = rows[0]
    for r in rows[1:]:
        total = _joined(total, r)
    made = {k: rows[0][k] for k in ("conv_id", "part", "seq", "whole")} | {k: total[k] for k in ("lo", "hi", "turns", *COUNTS, "head", "tail")}
    made["weights"] = _weights(lightest(len(rows), _block_edges([json.loads(r["weights"]) for r in rows]), STATES))
    return pa.Table.from_pylist([made], ARROW)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose rows come in order, the audit (as a text) before them."""

    def conversations() -> Iterator[tuple[int | None, str, Iterator[Row]]]:
        rows = (r for batch in batches for r in zip(*[x.to_pylist() for x in batch.columns], strict=True))
        ahead = next(rows, None)
        while ahead:
            conv, audit, ahead = ahead[0], ahead[3], next(rows, None)

            def own(conv: int | None = conv) -> Iterator[Row]:
                nonlocal ahead
                while ahead and ahead[1] and ahead[0] == conv:
                    yield ahead[2], ahead[3], ahead[4], ""
                    ahead = next(rows, None)

            yield conv, audit, own()

    for conv, audit, rows in conversations():
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([_sha(repaired(iter(audit), rows))])], ["conv_id", "repaired_sha256"])


def repairs(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, faults, the cheapest repair and the hash of its result.

    Rows of a conversation go by turn (nulls first), then role, then text. A null conv_id is a conversation. Rows that
    occur several times are duplicates of the first. turns: conv_id, turn, role, text; other columns are ignored."""
    same: Column = F.expr("conv_id <=> _conv")
    rows = written(damaged(turns))
    by = ["conv_id", "turn", "role", "text"]
    ordered = _seen(rows).repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(100))).sortWithinPartitions(*by)
    blocks = written(ordered.mapInArrow(_blocks, BLOCK))
    parts = blocks.where("not whole")
    for level, left in (("seq", "part"), ("part", None)):
        keys = ["conv_id", *([left] if left else [])]
        while parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            near = parts.withColumn("up", F.shiftright(F.col(level).cast("long"), GROUP)).groupBy(*keys, "up")
            parts = cut(near.applyInArrow(_combined, BLOCK).withColumn(level, F.shiftright(F.col(level), GROUP)).select(NAMES))
    ends = F.from_json("weights", "array<array<string>>")
    best = F.array_min(F.transform(F.filter(ends, lambda e: (e[0] == "0") & e[1].isin(*map(str, GOALS))), lambda e: F.struct(e[2].cast("long").alias("cost"), e[3].alias("audit"))))
    long = cut(parts.withColumn("best", best).withColumn("cost", F.col("best.cost")).withColumn("audit", F.col("best.audit")).select([c for c in NAMES if c != "repaired_sha256"]))
    audits = long.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
    theirs = rows.join(F.broadcast(long.select(F.col("conv_id").alias("_conv"))) if long.count() <= SENT else long.select(F.col("conv_id").alias("_conv")), same, "left_semi").withColumn("kind", F.lit(1))
    stream = audits.unionByName(theirs).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "kind", "role", "text", "n")
    hashed = stream.mapInArrow(_hashes, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    done = blocks.where("whole").select(NAMES).unionByName(long.join(hashed, same).select(NAMES))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = done.select(F.col("conv_id").alias("_conv"), gaps, *COUNTS, "cost", "audit", "repaired_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    every = turns.select(F.col("conv_id").cast("long")).distinct().join(done, same, "left")
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    def add(s: str, cost: str, letter: str) -> str:
        return f"case when {s} is null then null else {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}} end"

    def least(*s: str) -> str:
        return f"list_min(list_filter([{', '.join(s)}], lambda x: x is not null))"

    inserted = "select * replace (" + least("s2", add("s0", "5", "I"), add("s1", "5", "I"), add("s3", "5", "I")) + " as s2, " + least("s3", add("s2", "5", "I")) + " as s3) from (select * from paths)"
    closed = inserted.replace("(select * from paths)", f"({inserted})")
    keep = lambda s, initial: f"case when fault in ('', 'truncated') and left(role, 1) = '{initial}' then {add(s, 't', 'K')} end"
    reroled = lambda s: f"case when fault in ('', 'truncated') then {add(s, '1 + t', 'R')} end"
    before = ("s0", "s1", "s3")
    step = ", ".join([
        add("s0", "2", "D") + " as s0",
        least(add("s1", "2", "D"), keep("s0", "s")) + " as s1",
        least(add("s2", "2", "D"), *[keep(s, "u") for s in before], *map(reroled, before)) + " as s2",
        least(add("s3", "2", "D"), keep("s2", "a"), reroled("s2")) + " as s3",
    ])
    nothing = "cast(null as struct(c bigint, a varchar))"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANK)
    return f"""
with recursive {CRC_SQL},
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as h from conversations, crc_table),
e as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from d where h <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, rtrim(text, {blanks}) as seen from e),
f as (select *, case when seen = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(seen, 1) in ('.', '!', '?') then '' else 'truncated' end as fault,
 left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair from n),
o as (select *, case when fault = 'truncated' then 5 else 0 end as t from f),
counts as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
 count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as size from o group by conv_id),
paths as (select conv_id, 1 as i, {{'c': cast(0 as bigint), 'a': ''}} as s0, {nothing} as s1, {nothing} as s2, {nothing} as s3 from counts
 union all select p.conv_id, p.i + 1 as i, {step} from ({closed}) p join o on p.conv_id is not distinct from o.conv_id and p.i = o.i),
ends as (select c.*, {least("s0", "s3")} as best from ({closed}) p join counts c on p.conv_id is not distinct from c.conv_id and p.i = c.size + 1),
letters as (select conv_id, best.a as audit, unnest(range(1, length(best.a) + 1)) as j from ends),
places as (select conv_id, j, audit[j] as letter, length(replace(audit[1:j], 'I', '')) as i, length(replace(audit[1:j], 'D', '')) as e, length(replace(audit, 'D', '')) % 2 as s from letters),
lines as (select p.conv_id, p.j, case when letter = 'K' then o.role when (e - s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else o.text end as line
 from places p left join o on p.conv_id is not distinct from o.conv_id and p.i = o.i where letter <> 'D'),
texts as (select conv_id, string_agg(line, chr(10) order by j) as text from lines group by conv_id)
select v.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(text, '')) as repaired_sha256
from (select distinct conv_id from conversations) v left join ends on v.conv_id is not distinct from ends.conv_id left join texts on v.conv_id is not distinct from texts.conv_id"""


SQL = _sql()
