"""Spelling variants: words one edit apart, found by scanning sorted lists with reused rows of the edit matrix.

A word is cut in thirds. One edit falls into one third, so that two near words agree in the other two: they meet in
the list of those who share these two. Each list is sorted and scanned for every of its words: the banded rows of the
edit matrix (three cells) are kept by depth, an entry begins at the row of the prefix that it shares with the one before
(its LCP), and when a row exceeds one edit, all following entries that share that prefix are skipped. Lists of very
many words are dealt over several tasks by the word that is looked for.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.operators.skew import hot_of, spread_join
from shapelab.session import cut

from .common import CRC_SQL, LOWER, UPPER, crc32_sql, documents, written

#: Code points of a word at least; its occurrences at least; how much more often its form is.
LENGTH, OCCURS, TIMES = 7, 2, 10
#: Of the runs, one in DAMAGE (by hash) loses a code point.
DAMAGE = 31
#: Words that a task counts before it passes them on; characters of a text from which its runs are counted one by one.
FLUSH, LONG = 200_000, 1 << 20
RUN = re.compile(f"[a-zÀ-ÿ]{{{LENGTH},}}")


def _next_rows() -> list[int]:
    """The row after a row: three cells (0, 1, 2 for more), by which of the word's three letters there equal the new one."""
    out = []
    for row in range(27):
        left, mid, right = row // 9, row // 3 % 3, row % 3
        for same in range(8):
            a = min(left + 1 - (same & 1), mid + 1)
            b = min(mid + 1 - (same >> 1 & 1), right + 1, a + 1)
            c = min(right + 1 - (same >> 2), b + 1)
            out.append(min(a, 2) * 9 + min(b, 2) * 3 + min(c, 2))
    return out


NEXT, FIRST, DEAD = _next_rows(), 2 * 9 + 0 * 3 + 1, 26


def occurrences(text: str, prefix: int) -> Iterator[tuple[str, int]]:
    """Words of one text and how often they occur. prefix: crc32 of what stands before a run in its hash."""
    lower = text.encode().lower().decode()  # bytes are lowered in A-Z alone
    runs = Counter(RUN.findall(lower) if len(lower) < LONG else (m[0] for m in RUN.finditer(lower)))
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts and their occurrences. A null text has none; a null id is the empty text in a run's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in occurrences(text.as_py(), zlib.crc32(f"{i.as_py()}:".encode())):
                    seen[word] += n
                if len(seen) > FLUSH:
                    yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURS)


def _lists(word: str = "word") -> Column:
    """The lists in which a word stands: by which third may differ, and by the length of the shorter word of a pair."""
    w, size = F.col(word), F.char_length(word)
    out = []
    for short in (size, size - 1):
        a, b = F.floor(short / 3).cast("int"), F.floor(2 * short / 3).cast("int")
        for third, key in enumerate((F.right(w, short - a), F.concat(F.left(w, a), F.lit("."), F.right(w, short - b)), F.left(w, b))):
            out.append(F.when(short >= LENGTH, F.concat(F.lit(f"{third}:"), short.cast("string"), F.lit(":"), key)))
    return F.array_compact(F.array(*out))


class Scan:
    """A sorted list of words and its LCPs; finds those one edit from one of them."""

    def __init__(self, words: list[str]):
        self.words, self.lcp, self.jumps = words, [0], {}
        for a, b in zip(words, words[1:], strict=False):
            k = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                k += 1
            self.lcp.append(k)

    def _after(self, depth: int) -> list[int]:
        """By entry, the next one that does not share `depth` letters with it."""
        if depth not in self.jumps:
            out, nxt = [0] * len(self.words), len(self.words)
            for i in range(len(self.words) - 1, -1, -1):
                out[i] = nxt
                if self.lcp[i] < depth:
                    nxt = i
            self.jumps[depth] = out
        return self.jumps[depth]

    def near(self, word: str) -> list[int]:
        """Places of the words at one edit that are as long as `word` or one letter longer."""
        words, lcp, rows, p, i, found = self.words, self.lcp, [FIRST] * (len(word) + 2), f"\0{word}\0\0\0", 0, []
        while i < len(words):
            w, d = words[i], lcp[i]
            row = rows[d]
            while d < len(w):
                c = w[d]
                row = NEXT[row << 3 | (p[d] == c) | (p[d + 1] == c) << 1 | (p[d + 2] == c) << 2]
                if row == DEAD:
                    break
                d += 1
                rows[d] = row
            else:
                longer = len(w) - len(word)
                if longer == 0 and row // 3 % 3 == 1 or longer == 1 and row // 9 == 1:
                    found.append(i)
                i += 1
                continue
            i = self._after(d + 1)[i]
        return found


def _elsewhere(third: int, short: int, a: str, b: str) -> bool:
    """Whether the pair also meets in a list of a later third, which then has it."""
    x, y = short // 3, 2 * short // 3
    return third < 2 and a[:y] == b[:y] or third < 1 and a[:x] == b[:x] and a[y:] == b[len(b) - short + y :]


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words are one edit from each, and the most frequent of them (ties: the smallest).

    Words without any are left out. vocab: word (distinct), n; read more than once. Tasks pass on one row for a word and list, no pairs."""
    rows = vocab.select("word", "n", F.explode(_lists()).alias("list"))
    counts = cut(vocab.select(F.explode(_lists()).alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = hot_of(counts, "list", 6 * vocab.count())
    rows = rows.withColumn("part", F.lit(0)).withColumn("parts", F.lit(1))
    if hot is not None:
        rows = rows.drop("part", "parts").join(F.broadcast(hot), "list", "left").withColumn("parts", F.coalesce("_parts", F.lit(1))).drop("_parts")
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("asks", F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part"))
    rows = rows.select("list", "part", "word", "n", "asks").repartition("list", "part").sortWithinPartitions("list", "part", "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        out: list[tuple[str, int, str, int]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != key:
                    if len(group) > 1:
                        out += _list_results(key[0], group)
                    group, key = [], row[:2]
                group.append(row[2:])
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if len(group) > 1:
            out += _list_results(key[0], group)
        yield _rows(out)

    found = rows.mapInArrow(scan, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])


def _list_results(key: str, group: list[tuple[str, int, bool]]) -> list[tuple[str, int, str, int]]:
    """Of one list: each word with near ones in it, their number, and the best of them. group: word, n, whether it asks here."""
    third, short = int(key[0]), int(key[2 : key.index(":", 2)])
    words = [g[0] for g in group]
    scan, got = Scan(words), {}

    def add(a: int, b: int) -> None:
        n, word = group[b][1], words[b]
        k, best_n, best = got.get(a, (0, 0, ""))
        if n > best_n or n == best_n and word < best:
            best_n, best = n, word
        got[a] = (k + 1, best_n, best)

    for i, (word, _, asks) in enumerate(group):
        if asks and len(word) == short:
            for j in scan.near(word):
                if not _elsewhere(third, short, word, words[j]):
                    add(i, j)
                    if len(words[j]) > short:
                        add(j, i)
    return [(words[i], k, best, n) for i, (k, n, best) in got.items()]


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that is reached by following forms. forms: word, form, none of them null.

    A form is at least TIMES as frequent as its word, so that chains are short; each round doubles what is followed."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        counts = at.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_of(counts, "root", at.count())
        after = cut(spread_join(at, step, "root", hot, "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts. No words give no rows; repeated rows count each time."""
    vocab = written(vocabulary(docs, id_col, text_col))
    all_words = vocab.join(near_words(vocab), "word", "left")
    takes = F.col("form_n") >= TIMES * F.col("n")
    out = written(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    ends = roots(out.where(F.col("form").isNotNull()).select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


def _sql() -> str:
    return f"""
with {CRC_SQL},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= {LENGTH} group by all),
hashed as (select run, n, {crc32_sql("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from counted, crc_table),
words as (select case when h % {DAMAGE} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
v as (select word, cast(sum(n) as bigint) as n from words where length(word) >= {LENGTH} group by word having sum(n) >= {OCCURS}),
cuts as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from v)),
pairs as (select a.word, b.word as near, b.n from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
 union select a.word, v.word, v.n from cuts a join v on a.rest = v.word union select v.word, a.word, a.n from cuts a join v on a.rest = v.word),
best as (select word, count(*) as n_near, (min({{'m': -n, 'w': near}})).w as form, max(n) as form_n from pairs group by word),
forms as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= {TIMES} * v.n then form end as form, case when form_n >= {TIMES} * v.n then form_n end as form_n from v left join best using (word)),
chains as (select word, word as last, 0 as k from forms union all select c.word, f.form, k + 1 from chains c join forms f on f.word = c.last where f.form is not null)
select word, form, root, n, n_near, form_n from forms join (select word, max_by(last, k) as root from chains group by word) using (word)"""


SQL = _sql().replace("with crc_table", "with recursive crc_table")
