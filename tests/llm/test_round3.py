"""Conversation repair, repeated strings and spelling variants against brute-force versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shapelab.llm import conversations, queries, repeats, spelling

from .test_llm import SMALL, awkward, frame, prose

TURNS = "conv_id long, turn long, role string, text string, key string, n long, kind int, part string, again boolean, _conv long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, 8, "p", True, 9) for r in rows], TURNS)


def awkward_talk():
    r = random.Random(3)
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, None, None), (None, 1, "system", "Be good."), (None, 2, "user", "So?"), (None, None, "assistant", ""), (4, 5, "", "x"), (5, 9, "tool", "ok!")]
    for c in range(10, 60):
        rows += [(c, t, r.choice(["user", "assistant", "system", "user", "assistant", None]), r.choice(["One.", "Two!", "three", "", " \t", "Four? \n", "One."])) for t in range(r.randrange(5))]
    return rows


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def brute_repair(rows):
    """Every sequence of edits with up to two inserts in a row."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
        seen.add((role, text))
        faults.append(fault)
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults, strict=True)):
            continue
        for gaps in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:], strict=True))
            cost = 5 * sum(gaps) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, faults, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            size = len(audit.replace("D", ""))
            want = ("s" if size % 2 else "") + "ua" * (size // 2)
            if size == 1:
                continue
            lines, left, ok = [], iter(rows), True
            for e in audit:
                row = None if e == "I" else next(left)
                if e == "D":
                    continue
                need = want[len(lines)]
                if e == "K":
                    ok = ok and row[2][:1] == need
                else:
                    ok = ok and need != "s"
                role = row[2] if e == "K" else {"u": "user", "a": "assistant", "s": ""}[need]
                lines.append(f"{role}:{'' if e == 'I' else row[3]}")
            if ok:
                best = cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *best)


def repairs(df):
    return {r.conv_id: tuple(r)[1:] for r in conversations.repairs(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair_against_all_edits(spark):
    rows = awkward_talk()
    got = repairs(talk(spark, rows))
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    assert set(got) == {r[0] for r in rows}
    for c, result in got.items():
        if len(by[c]) <= 4:
            assert result == brute_repair(by[c]), c


def test_repair_in_blocks(spark, monkeypatch):
    """A long conversation is the same in blocks of two rows, combined level by level, as in one."""
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b.", "c", ""]) + str(r.randrange(40))) for c in (1, 2, 3) for t in range(90)]
    whole = repairs(talk(spark, rows))
    monkeypatch.setattr(conversations, "ROWS", 2)
    monkeypatch.setattr(conversations, "GROUP", 1)
    assert repairs(talk(spark, rows)) == whole and all(v[5] > 0 for v in whole.values())
    assert repairs(talk(spark, rows).where("false")) == {}


def test_an_agenda_pops_the_lightest_first():
    """Popped weights never get smaller, and a dear single step loses to cheap ones."""
    edges = {(0, 0): [(1, 0, 3, "b"), (2, 0, 9, "a")], (1, 0): [(2, 0, 3, "c")]}
    assert conversations.lightest(2, lambda at, q: edges.get((at, q), ()), (0,)) == {(0, 0): (6, "bc")}


def plain(rows, columns):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in rows)))


@pytest.mark.parametrize("name", ["op11_repair", "op13_spelling"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(got.collect(), want.columns) == sorted(str(r) for r in want.fetchall())


def brute_repeats(texts, span):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if counts[d[i : i + span]] > 1:
                gone[i : i + span] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def without(spark, rows):
    return Counter(map(tuple, repeats.without_repeats(frame(spark, rows)).collect()))


def brute_rows(rows):
    return Counter((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], repeats.SPAN), strict=True))


def repeated_rows():
    """Passages around the length that counts, at ends and in the middle, overlapping, within a text, with bytes of several letters; near copies; runs of one letter."""
    r, rows = random.Random(4), awkward()
    passage = prose(77, 160)
    for k, (a, n) in enumerate([(0, 399), (0, 400), (0, 401), (13, 640), (200, 500), (350, 420), (600, 400), (599, 402)]):
        part = passage[a : a + n]
        rows += [(100 + k, prose(200 + k, 60) + part + prose(300 + k, 50), "en"), (120 + k, part + prose(400 + k, 9), "en"), (140 + k, prose(500 + k, 70) + part, "en")]
    rows += [(200, "é" * 150 + passage[:300], "fr"), (201, "x" + "é" * 150 + passage[:300], "fr"), (202, "a" * 900, None), (203, "a" * 399 + "b", None), (204, "ab" * 450, None), (205, passage + "|" + passage, None)]
    base = prose(9, 500)
    for k in range(12):
        at = r.randrange(len(base))
        rows.append((300 + k, base[:at] + str(k) + base[at + 1 :], "en"))
    return rows


def test_repeats_against_all_strings(spark):
    rows = repeated_rows()
    got = without(spark, rows)
    assert got == brute_rows(rows)
    assert sum(k[2] for k in got) > 20_000
    assert without(spark, []) == Counter()


def test_repeats_over_the_edge_of_a_piece(spark):
    """A text of more than one piece, with a passage where two of them meet."""
    r = np.random.default_rng(5)
    long = "".join(map(chr, r.integers(97, 123, repeats.PIECE + 5000)))
    at = repeats.PIECE - 250
    rows = [(1, long, "en"), (2, "0" + long[at : at + 500] + "0", "en"), (3, "1" + long[at + 90 : at + 489] + "1", "en")]
    got = {k[0]: k[1:4] for k in without(spark, rows)}
    assert got == {1: (len(long), 500, 1), 2: (502, 500, 1), 3: (401, 0, 0)}


def test_repeats_on_all_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op12_repeats(spark, SMALL).collect()}
    want = dict(zip([r.doc_id for r in rows], brute_repeats([r.text for r in rows], repeats.SPAN), strict=True))
    assert got == want and sum(v[1] for v in want.values()) > 0


def brute_variants(rows):
    counts = Counter()
    for d, t in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in v if abs(len(x) - len(w)) < 2 and near(w, x)] for w in v}
    form = {w: min(x, key=lambda y: (-v[y], y)) for w, x in by.items() if x}
    form = {w: f for w, f in form.items() if v[f] >= 10 * v[w]}
    out = {}
    for w, n in v.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(by[w]), v[form[w]] if w in form else None)
    return out


def variants(spark, rows):
    return {r.word: tuple(r)[1:] for r in spelling.variants(frame(spark, rows)).collect()}


def test_variants_against_all_pairs(spark):
    r = random.Random(6)
    stems = ["".join(r.choice("abcdé") for _ in range(r.randrange(6, 11))) for _ in range(40)]
    words = [w for s in stems for w in [s] * r.choice([1, 3, 30, 400])]
    for s in stems:
        for _ in range(4):
            i = r.randrange(len(s))
            words += [r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abcdéxÿ") + s[i + 1 :], s[:i] + "a" + s[i:], s.upper()])] * r.choice([1, 2, 3, 25])
    words += ["chainedxy"] * 3 + ["chainedx"] * 60 + ["chained"] * 1500
    r.shuffle(words)
    rows = [(i, " ".join(words[i::50]), "en") for i in range(50)] + awkward() + [(900, "Œuvre×fine÷gaps a1b2c3 É" + "é" * 2000, "fr"), (901, "É" + "é" * 2000, "fr")]
    got = variants(spark, rows)
    assert got == brute_variants([x[:2] for x in rows])
    assert sum(1 for v in got.values() if v[0]) > 20 and got["chainedxy"][:2] == ("chainedx", "chained")
    assert variants(spark, []) == {}


def test_lists_that_are_dealt(spark, monkeypatch):
    from shapelab.operators import skew

    r = random.Random(2)
    words = sorted({"prefix" + "".join(r.choice("abc") for _ in range(3)) for _ in range(60)})
    rows = [(i, " ".join(words), "en") for i in range(3)]
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "KEYS", 20)
    assert variants(spark, rows) == brute_variants([x[:2] for x in rows])


def test_rows_of_the_edit_matrix():
    """The table of banded rows gives the edit distance, up to one."""
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(n)) for n in (5, 6) for _ in range(40)})
    scan = spelling.Scan(words)
    for w in words:
        near = {words[i] for i in scan.near(w)}
        want = {x for x in words if len(x) == len(w) and sum(a != b for a, b in zip(x, w, strict=True)) == 1 or len(x) == len(w) + 1 and any(x[:i] + x[i + 1 :] == w for i in range(len(x)))}
        assert near == want


def test_near_duplicates_of_hot_keys(spark):
    """Many copies of one text are dealt over tasks, many rows without words stay alone, and so do rows without an id."""
    from shapelab.llm import neardup

    words = " ".join(f"w{k}" for k in range(40))
    rows = [(k, words) for k in range(600, 0, -1)] + [(k, None if k % 2 else " \n") for k in range(1000, 1300)] + [(2000, words + " more"), (None, words)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 36
        elif 1000 <= r.doc_id < 1300:
            assert r.component_id == r.doc_id and r.kept and r.n_shingles == 0
        else:
            assert r.component_id == 1 and r.kept == (r.doc_id == 1) and r.n_shingles == (37 if r.doc_id == 2000 else 36)
