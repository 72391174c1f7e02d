"""Personal data: patterns, and terms that give protected entities away.

E-mail addresses, IP addresses, card and phone numbers are found by patterns, and so are secrets: runs of letters and
digits that no word is, whose characters carry SECRET_BITS or more. Every value found is a protected
entity, and so is every class of values: that a text holds a secret at all is disclosed by a word that stands beside
secrets only, however few of them repeat. Words that stand near an entity are judged by the corpus: their pointwise
mutual information with the entity, as a share of the entity's own information content, says how far the word alone
reveals it. Words at or over DISCLOSES of a value, or CLASS_DISCLOSES of a class, seen with it in at least SUPPORT
different texts (copies of one text are one), are generalised; words that occur nowhere else are removed. A word that
reveals does so wherever it stands, so all its places in all texts are found, with or without the entity beside them.

A term's count over all documents is bounded from below by its documents beside entities, and then by a part of all
documents; a term that these already make too common cannot reveal, so only the others are counted in all documents.

All of it is DataFrame expressions. Defined results: a null text is the empty text, without spans; repeated
rows get equal results; a null doc_id stays null; a very long text is read by positions in chunks, in time that grows
with its length; an empty table has no rows; other columns are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.session import cut

from .common import documents, free, small, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns give, without going back: a run of a pattern's first characters is
#: entered at its start, or where the match before it ended (\G), and is never given up in part.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: What a text without any match of a kind lacks, found faster than the pattern.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "+", "secret": "[A-Za-z][0-9]|[0-9][A-Za-z]"}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Letters, digits and all beyond ASCII, two at least.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]{2,}+"
#: Letters and digits that change places like no word's do.
_MIXED = "(?:[0-9]+[A-Za-z]+){2}|^[A-Z0-9]*[0-9][A-Z0-9]*$"
SECRET_BITS = 48
#: Hits that are folded, and code points that are cut, at once.
FOLD, CHUNK = 256, 2048
#: Code points on either side of an entity that are its context.
WINDOW = 80
DISCLOSES, SUPPORT = 0.8, 3
#: A class is in many texts, so that its share of information grows slowly with the word's certainty: at 0.8, a class in a
#: tenth of all texts would give away words that stand beside it in three texts of five.
CLASS_DISCLOSES = 0.95
#: Up to so many candidate terms are sent to every executor; more are joined by key.
BROADCAST_TERMS = 20_000
#: The first part of the documents that bounds the counts of terms is one in so many.
PART = 16
LABELS = {"secret": "[SECRET]", "email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "term-removed": ""}


def _fold(xs: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of what `step` gives for each of xs and the position reached, nulls left out. step: (position, x) -> (next position, element).

    Arrays are built from parts of FOLD elements, so that none is copied once per element of a long one."""
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        at, one = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.when(one.isNotNull(), F.concat(acc["done"], F.array(one))).otherwise(acc["done"]).alias("done"))

    def outer(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("done")), inner)
        return F.get(F.transform(F.array(got), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["done"], F.array(g["done"])).alias("done"))), 0)

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / FOLD).cast("int"), F.lit(0))), lambda k: F.slice(xs, k * FOLD + 1, FOLD))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.when(F.size(xs) > 0, F.aggregate(parts, start, outer, lambda acc: F.flatten(acc["done"]))).otherwise(none)


def _pairs(text: Column, pattern: Column | str, hits: Column) -> Column:
    """Array of (gap, hit): the length of what stands before each hit, and the hit."""
    gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))


def found(text: Column, pattern: str) -> Column:
    """Array of (s, e, hit): matches from left to right with code point offsets."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        e = s + F.length(x["hit"])
        return e, F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit"))

    return _fold(_pairs(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), "struct<s:int,e:int,hit:string>", step)


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def piece(parts: Column, s: Column, e: Column) -> Column:
    """Code points s to e of a text in chunks, at a cost that doesn't depend on s."""
    first = F.floor(s / CHUNK).cast("int")
    many = F.greatest(F.floor((e - 1) / CHUNK).cast("int") - first + 1, F.lit(0))
    return F.substr(F.array_join(F.slice(parts, first + 1, many), ""), s - first * CHUNK + 1, F.greatest(e - s, F.lit(0)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def bits(hit: Column) -> Column:
    """Information of a string's characters: its length times the entropy of what they are."""
    n = F.length(hit).cast("double")
    alike = F.transform(F.array_distinct(F.split(hit, "")), lambda c: (F.length(hit) - F.length(F.replace(hit, c, F.lit("")))).cast("double"))
    return n * F.log2(n) - F.aggregate(alike, F.lit(0.0), lambda acc, k: acc + k * F.log2(k))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(13, 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "secret":
        return F.when(hit.rlike(_MIXED) & hit.rlike("[A-Za-z]"), bits(hit) >= SECRET_BITS).otherwise(False)
    return F.lit(True)


def _spans(text: Column, kind: str, hits: Column) -> Column:
    """Array of (kind, s, e, hit) of the valid matches."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        e = s + F.length(x["hit"])
        return e, F.when(_valid(kind, x["hit"]), F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["hit"].alias("hit")))

    return _fold(_pairs(text, PATTERNS[kind], hits), "struct<kind:string,s:int,e:int,hit:string>", step)


def _context(parts: Column, span: Column) -> Column:
    """Words (lower-cased) of the span's line within the window; a word that the window cuts is left out."""
    low = F.greatest(span["s"] - WINDOW - 1, F.lit(0))
    left = F.substring_index(piece(parts, low, span["s"]), "\n", -1)
    right = F.substring_index(piece(parts, span["e"], span["e"] + WINDOW + 1), "\n", 1)
    words = lambda part, at: F.transform(found(part, WORD), lambda w: F.struct(_low(w["hit"]).alias("term"), (w["s"] + at).alias("s"), (w["e"] + at).alias("e")))
    a = words(left, span["s"] - F.length(left))
    b = words(right, span["e"])
    edge = lambda w: (w["s"] > low) | (low == 0)
    inside = F.filter(F.concat(a, b), lambda w: edge(w) & (w["e"] < span["e"] + WINDOW + 1) & ~w["term"].rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(inside, lambda w: w["term"]))


def _value(span: Column) -> Column:
    """Name of a value; that of a class is its kind alone. Secrets have any length, so a hash names them."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["hit"])).when(span["kind"] == "secret", F.md5(span["hit"])).otherwise(F.lower(span["hit"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _low(text: Column) -> Column:
    """Lower case, of as many code points as the text has: the one letter that would become two is one."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _terms(text: Column) -> Column:
    """Distinct words of a text as terms."""
    return F.array_distinct(F.regexp_extract_all(_low(text), F.lit(WORD), F.lit(0)))


def _places(text: Column, names: Column, kinds: Column) -> Column:
    """Array of (kind, s, e): every place of the terms in the whole text."""
    # terms hold nothing that has a meaning in a pattern
    whole = WORD[: WORD.index("]") + 1]
    pattern = F.concat(F.lit(f"(?<!{whole})(?:"), F.array_join(names, "|"), F.lit(f")(?!{whole})"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        e = s + F.length(x["hit"])
        return e, F.struct(F.get(kinds, F.array_position(names, x["hit"]).cast("int") - 1).alias("kind"), s.alias("s"), e.alias("e"))

    return _fold(_pairs(_low(text), pattern, F.regexp_extract_all(_low(text), pattern, F.lit(0))), "struct<kind:string,s:int,e:int>", step)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (of the text), spans by kind as listed then start, secrets, and the context words of each span."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    may = lambda k: F.contains("text", F.lit(HINTS[k])) if len(HINTS[k]) == 1 else F.col("text").rlike(HINTS[k])
    hits = lambda k: F.when(may(k), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("h"), *[hits(k).alias(f"hit_{k}") for k in PATTERNS])
    of = {k: _spans(F.col("text"), k, F.col(f"hit_{k}")) for k in PATTERNS}
    d = d.select("doc_id", "text", "h", F.concat(*[of[k] for k in KINDS]).alias("spans"), of["secret"].alias("secrets"))
    some = F.size("spans") + F.size("secrets") > 0
    d = d.select("doc_id", "h", "spans", "secrets", F.when(some, chunks(F.col("text"))).alias("parts"))
    context = F.transform(F.concat("spans", "secrets"), lambda x: F.struct(_value(x).alias("entity"), x["kind"].alias("kind"), _context(F.col("parts"), x).alias("words")))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias(c)
    return d.select("doc_id", "h", bare("spans"), bare("secrets"), F.when(some, context).alias("context"))


def disclosing(near: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """(entity, term, only): terms that reveal an entity; None if none has the support.

    near: doc_id, h, entity (a value, or a class), term. Counted are documents: n of all, of the entity, of the term, of both. Everything is
    aggregated before it is joined, so that a common entity or term is one row where it meets others."""
    each = near.distinct()
    both = each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    both = cut(both.where(f"n_both >= {SUPPORT} and h0 <> h1").select("entity", "term", "n_both"))
    texts = each.select("entity", "term", "h").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    both = cut(both.join(texts.select("entity", "term"), ["entity", "term"]))
    if both.isEmpty():
        return None
    n = docs.count()
    is_class = F.col("entity").isin(*PATTERNS)
    least_share = F.when(is_class, CLASS_DISCLOSES).otherwise(DISCLOSES)
    share = lambda n_term: F.ln(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * F.col(n_term))) / F.ln(F.lit(float(n)) / F.col("n_entity"))
    entity = each.select("entity", "doc_id", "h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # a term is in no fewer documents than it has beside entities
    least = each.select("term", "doc_id", "h").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    # classes are a handful of very frequent keys, values are many
    sized = both.where(is_class).join(F.broadcast(entity.where(is_class)), "entity").unionByName(both.where(~is_class).join(entity.where(~is_class), "entity"))
    pairs = sized.join(least, "term").where(f"n_entity < {n}")
    pairs = cut(pairs.where(share("n_least") >= least_share - 1e-9).select("entity", "term", "n_both", "n_entity"))

    def counted(of: DataFrame) -> DataFrame:
        """Documents of `of` with each term of the pairs left."""
        words = of.select(F.explode(_terms(text_of(text_col))).alias("term"))
        return words.join(small(pairs.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    # nor in fewer than a part of all documents has: what that part makes too common isn't counted in all
    some = counted(docs.where(F.pmod(F.xxhash64(text_of(text_col)), F.lit(PART)) == 0))
    pairs = cut(pairs.join(some, "term", "left").where(F.col("n_term").isNull() | (share("n_term") >= least_share - 1e-9)).drop("n_term"))
    counts = pairs.join(counted(docs), "term")
    return cut(counts.where(share("n_term") >= least_share).select("entity", "term", (F.col("n_both") >= F.col("n_term")).alias("only")))


def term_places(docs: DataFrame, revealing: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, g, terms): by doc_id and hash of the text, all places of revealing terms in texts that have some."""
    kind = F.when(F.max("only"), "term-removed").otherwise("term").alias("kind")
    terms = small(revealing.groupBy("term").agg(kind), BROADCAST_TERMS)
    d = docs.select(docs[id_col].cast("long").alias("i"), text_of(text_col).alias("text"))
    words = d.select("i", F.xxhash64("text").alias("g"), F.explode(_terms(F.col("text"))).alias("term"))
    has = words.join(terms, "term").groupBy("i", "g").agg(F.array_sort(F.collect_set(F.struct("term", "kind"))).alias("has"))
    has = cut(has.select(F.col("i").alias("_i"), F.col("g").alias("_g"), F.col("has.term").alias("names"), F.col("has.kind").alias("kinds")))
    texts = d.withColumn("g", F.xxhash64("text")).join(has, F.expr("i <=> _i and g = _g"))
    return texts.select("i", "g", _places(F.col("text"), F.col("names"), F.col("kinds")).alias("terms")).dropDuplicates(["i", "g"])


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, h, base spans, secrets and term spans, arrays of (kind, s, e)."""
    base = written(base_spans(docs, id_col, text_col))
    each = base.where("context is not null").select("doc_id", "h", F.explode("context").alias("x")).select("doc_id", "h", F.array("x.entity", "x.kind").alias("of"), "x.words")
    each = each.select("doc_id", "h", "of", F.explode("words").alias("term"))
    near = cut(each.select("doc_id", "h", F.explode("of").alias("entity"), "term"))
    revealing = disclosing(near, docs, text_col)
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if revealing is None or revealing.isEmpty():
        return base.select("doc_id", "h", "spans", "secrets", none.alias("terms"))
    terms = cut(term_places(docs, revealing, id_col, text_col))
    joined = base.join(terms, F.expr("doc_id <=> i and h = g"), "left")
    return joined.select("doc_id", "h", "spans", "secrets", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every base span replaced by its kind and every revealing term generalised or removed."""
    found_ = private_spans(docs, id_col, text_col).where("size(spans) + size(secrets) + size(terms) > 0").withColumn("spans", F.concat("spans", "secrets"))
    # a term inside or across an entity goes with it
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda x: (t["s"] < x["e"]) & (x["s"] < t["e"])))
    spans = F.array_sort(F.transform(F.concat(F.col("spans"), apart), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    i, h, at = (free(docs, x) for x in ("_id", "_hash", "_spans"))
    found_ = cut(found_.select(F.col("doc_id").alias(i), F.col("h").alias(h), spans.alias(at)).dropDuplicates([i, h]))
    label = lambda k: F.coalesce(*[F.when(k == a, b) for a, b in LABELS.items()])
    text, parts, ends = text_of(text_col), free(docs, "_parts"), free(docs, "_ends")

    def step(to: Column, x: Column) -> tuple[Column, Column]:
        gap = F.struct(to.alias("s"), x["s"].alias("e"), label(x["kind"]).alias("label"))
        return F.greatest(to, x["e"]), F.when(x["s"] >= to, gap)

    joined = docs.join(found_, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    gaps = F.when(F.col(at).isNotNull(), _fold(F.col(at), "struct<s:int,e:int,label:string>", step))
    joined = joined.withColumn(parts, F.when(F.col(at).isNotNull(), chunks(text))).withColumn(ends, F.array_max(F.transform(at, lambda x: x["e"]))).withColumn(at, gaps)
    clean = F.transform(at, lambda x: F.concat(piece(F.col(parts), x["s"], x["e"]), x["label"]))
    clean = F.concat(F.array_join(clean, ""), piece(F.col(parts), F.col(ends), F.length(text)))
    return joined.withColumn(text_col, F.when(F.col(at).isNotNull(), clean).otherwise(F.col(text_col))).drop(i, h, at, parts, ends)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = private_spans(documents(spark, sf_dir))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.when(x["kind"].startswith("term"), "term").otherwise(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    everything = F.concat("spans", "secrets", "terms")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(said("spans"), 256).alias("base_sha256"), said(everything).alias("spans"), F.size(everything).cast("long").alias("n_spans"))
