"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: an element node is a path of tags with their classes, a style node one
sequence of children seen below it. Presentation that varies from page to page, and content that differs from
page to page, is important; what repeats is not. The importance of an element is the entropy of its styles,
and, below it, that of its children weighted by how often each style occurs; a leaf's is the entropy of its
texts over the pages, without the share of them that is links (links inside an article count as its text), and by
their presentation: texts of one length that hold little of the host's text (an advert, a footer) are of little
importance though every page has others. The latter doesn't count against headings, and elements beside what holds
most of the host's text: a short line in an article is part of it. A branch is left out if it and all elements in it are under THRESHOLD.

A host with few pages says too little about what repeats: an element with text backs off to the same path on all
other hosts, by the weight of PAGES pages, and these to full importance; inside an article or main element ROLE_PAGES pages of
full importance are added. The tree knows no names. Besides, and unless `names` is off, branches that a tag, role or class name calls a menu,
header, footer, sidebar, notice, advert, form or comments are believed to be noise, unless next to all of the host's
text lies in them: then the one that holds most of it is judged like any other. Pages of a host whose longest
texts, half of all their text, are the same are copies, and together count as one page. Scripts, styles and the head never hold text.

The importance of a node is linear in that of its children, so it is the sum over all elements below it of their own
parts, each times the product of the factors on the way: two shuffles over the nodes and their ancestors, however
deep the pages are. Nothing is grouped by host; nodes that very many others lie below are dealt over several tasks.
Elements nested deeper than DEPTH are taken as children of the element at that depth, as browsers do.

Defined results: a null or empty html has the empty text; broken markup is read as far as it goes (open tags end
with the page); a null or odd url is the host ""; repeated pages get equal texts, whatever their page_id; time and
memory grow with a page's length; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelab.operators.skew import hot_keys, spread_join
from shapelab.session import cut

from .common import small_batches

THRESHOLD, DAMPING = 0.3, 0.9
#: Weight of the prior, in pages, and inside what a page declares to be its content.
PAGES, ROLE_PAGES = 2, 50
#: Share of a host's text from which short texts of one length count in full; share that the children of an element hold if all in it is content.
BULK, HOLDS = 0.25, 0.5
#: Names are not believed on a host with less than this share of its text outside of what they call noise.
CLEAN = 0.15
DEPTH = 512
#: Groups of copies, and unimportant paths by host and in all, that are sent to every executor at most; more are joined by key.
BROADCAST_COPIES, LOW_OF_HOST, BROADCAST_LOW = 100_000, 500, 100_000

# Tags by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "button", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title"}
NOISE = {"nav", "header", "footer", "aside", "menu", "form", "dialog"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: An opening tag of these ends an open p, as HTML has it.
ENDS_P = BLOCK - {"caption", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
NOISE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adbox|adslot|adunit|adspace|adsense|adsbygoogle|adv|advert\w*|\w*banner|sponsor\w*|promo\w*|\w*nav|nav\w*|\w*menu|menu\w*|breadcrumb\w*|header|masthead|topbar"
    r"|\w*footer|contentinfo|\w*sidebar|side|aside|rail|complementary|widget\w*|cookie\w*|consent|gdpr|notice\w*|alert|warning|announcement|popup|modal|overlay|dialog|newsletter|subscribe|subscription"
    r"|signup|login|search|share|sharing|social|comments?|commentlist|discussion|feedback|reply|replies|respond|disqus|reader-comments?|related|recommend\w*|popular|trending|copyright|legal|disclaimer"
    r"|pagination|pager|skip|toolbar|form)(?:$|[-_ ])",
    re.I,
)
#: Names of elements around a whole page, which may be called after what else they hold.
WHOLE = re.compile(r"layout|wrap|container|page|has-|with-|grid|row|col", re.I)
CONTENT_ROLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)[-_]+(?:header|head|title|body|text)", re.I)

#: Names of noise that may be the article's own inside of one.
MILD_NAMES = re.compile(r"(?:^|[-_ ])(?:notice\w*|alert|warning|announcement|legal|disclaimer|feedback|copyright|popular|side|rail|header|search|dialog|discussion|announcement|skip|form)(?:$|[-_ ])", re.I)

# A quote opens a value only right after =; every character is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("children", "depth", "name", "noise", "parent", "path", "role", "tag", "top")

    def __init__(self, tag: str, name: str, parent: Node | None, noise: bool) -> None:
        self.tag, self.name, self.parent, self.noise = tag, name, parent, noise
        self.path = child_path(parent.path, name) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []


def child_path(path: int, name: str) -> int:
    """A path of any depth has a key of one length, a signed 64-bit value."""
    x = xxhash.xxh3_64_intdigest(f"{path}/{name}")
    return x - (1 << 64) if x >> 63 else x


def parse(page: str) -> Node:
    """The page's elements below a root; what a browser would close by itself is closed."""
    root = Node("", "", None, False)
    stack, at, end = [root], 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].children.append(html.unescape(page[at:lt]))
        if lt >= end:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:  # an inline end tag closes no block
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in SAME_ENDS.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
        names, hidden = [], False
        for key, x, y, z in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            key = key.lower()
            if key in ("class", "id", "role") and (value := (x or y or z).strip()):
                names.append(value)
            elif key == "hidden" or key == "aria-hidden" and (x or y or z).strip().lower() == "true":
                hidden = True
        name = _DIGITS.sub("#", " ".join(names).lower()).replace(">", "")
        inside = any(x.tag in CONTENT_ROLES for x in stack)
        noise = hidden or tag in NOISE or bool(NOISE_NAMES.search(MILD_NAMES.sub(" ", name) if inside else name))
        if tag in HEADINGS or tag in ("html", "body", *CONTENT_ROLES) or OWN_HEADER.search(name):
            noise = hidden
        if tag in CONTENT_ROLES:
            for x in stack:
                if x.noise and x.tag not in NOISE and (tag == "main" or WHOLE.search(x.name)):
                    x.noise = False
        if tag == "header" and stack[-1].tag in CONTENT_ROLES and not NOISE_NAMES.search(name):
            noise = False  # an article's own heading
        node = Node(tag, f"{tag}.{name}" if name else tag, stack[-1], noise)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not (m[3] or "").endswith("/") and len(stack) <= DEPTH:
            stack.append(node)
    return root


def elements(root: Node) -> Iterator[Node]:
    """Elements that may hold text, in page order."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag not in SILENT and c.tag not in VOID]


def own_text(x: Node) -> tuple[str, int]:
    """The text right below an element, with that of inline elements, and how many of its characters are links."""
    out, linked, todo = [], 0, [(c, x.tag == "a") for c in reversed(x.children)]
    while todo:
        c, link = todo.pop()
        if isinstance(c, str):
            out.append(c)
            linked += len(c) if link else 0
        elif c.tag not in SILENT and c.tag not in BLOCK:
            todo += [(y, link or c.tag == "a") for y in reversed(c.children)]
    text = _SPACE.sub(" ", "".join(out)).strip()
    return text, min(linked, len(text))


def style_of(x: Node) -> list[str]:
    """The names of the children in order, runs of one name once."""
    names: list[str] = []
    for c in x.children:
        if isinstance(c, Node) and c.tag not in SILENT and c.tag not in VOID and (not names or names[-1] != c.name):
            names.append(c.name)
    return names


def blocks(root: Node, drop: set[int], keep: int | None = None, noisy: bool = True) -> list[str]:
    """Texts of the blocks in page order without the branches in `drop`, or those called noise (but for `keep`)."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in SILENT or (x.path in drop and x.tag in BLOCK) or (x.noise and noisy and x.path != keep):  # words inside a block stay together
            if x.tag in BLOCK:
                flush()
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) >> 1


def described(page: str) -> Iterator[tuple[str, int, int, float, int, int, bool, bool, Node]]:
    """(kind, path, value, n, chars, linked, noise, role, element) of a page's elements, each path and value once.

    Kind s: a style of the path. e: how much of its parent's children the path is, a style's children sharing one.
    t: a text of the path. m: characters by the topmost branch that is called noise (0: none)."""
    root = parse(page)
    root.top, root.role = 0, False
    seen: set[tuple] = set()
    mass: dict[int, int] = {}
    for x in elements(root):
        if x.parent:
            up = x.parent
            x.top = up.top or (x.path if x.noise else 0)
            x.role = up.role or x.tag in CONTENT_ROLES
        names = style_of(x)
        value = _hash(">".join(names))
        if x.parent and ("s", x.path, value) not in seen:
            seen.add(("s", x.path, value))
            yield "s", x.path, value, 1.0, 0, 0, bool(x.top), x.role, x
        if names and ("e", x.path, value) not in seen:
            seen.add(("e", x.path, value))
            own = list(dict.fromkeys(names))
            for name in own if x.parent else ():
                yield "e", child_path(x.path, name), 0, 1 / len(own), 0, 0, False, False, x
        text, linked = own_text(x)
        if text:
            if x.tag in BLOCK or not x.parent:
                mass[x.top] = mass.get(x.top, 0) + len(text)
            key = ("t", x.path, _hash(text))
            if x.parent and key not in seen:
                seen.add(key)
                yield *key, 1.0, len(text), 0 if x.role else linked, bool(x.top), x.role, x
    for top, chars in mass.items():
        yield "m", top, 0, 1.0, chars, 0, False, False, root


def chain(x: Node) -> list[int]:
    """The paths from the outermost element to x."""
    out = []
    while x.parent:
        out.append(x.path)
        x = x.parent
    return out[::-1]


_COUNTS = {"host": pa.int64(), "kind": pa.string(), "path": pa.int64(), "value": pa.int64(), "n": pa.float64(), "chars": pa.float64(), "linked": pa.float64(), "noise": pa.bool_(), "role": pa.bool_(), "heading": pa.bool_(), "chain": pa.list_(pa.int64())}


def _pages(pages: DataFrame, page_col: str, url_col: str) -> DataFrame:
    """page_id, url, host (hashed), page and copies: a key of the host and the longest texts, that make up half of the page's text."""
    p = pages.select("page_id", F.col(url_col).alias("url"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.coalesce(F.col(page_col).cast("string"), F.lit("")).alias("page"))
    texts = F.split(F.regexp_replace("page", r"(?is)<(script|style)\b.*?</\1\s*>", "<>"), "<[^>]*>")
    texts = F.array_sort(F.transform(F.filter(texts, lambda x: F.trim(x) != ""), lambda x: F.struct((-F.length(x)).alias("k"), x.alias("t"))))
    half = F.aggregate(texts, F.lit(0), lambda acc, x: acc - x["k"]) / 2
    step = lambda acc, x: F.when(acc["left"] > 0, F.struct((acc["left"] + x["k"]).alias("left"), F.xxhash64(acc["h"], x["t"]).alias("h"))).otherwise(acc)
    return p.withColumn("copies", F.aggregate(texts, F.struct(half.alias("left"), F.col("host").alias("h")), step, lambda acc: acc["h"]))


def style_counts(pages: DataFrame, page_col: str = "html", url_col: str = "url") -> DataFrame:
    """The merged trees: what `described` says, summed over the pages of each host; copies of a page weigh one together."""
    pages = small_batches(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                counts: dict[tuple, list] = {}
                for host, w, page in zip(*(b.column(k).slice(at, 200).to_pylist() for k in range(3))):
                    for kind, path, value, n, chars, linked, noise, role, x in described(page):
                        old = counts.get((host, kind, path, value))
                        if old is None:
                            of = x if kind == "s" else None
                            counts[host, kind, path, value] = [n * w, chars * w, linked * w, noise, role, x.tag in HEADINGS, of and chain(of)]
                        else:
                            old[0] += n * w
                            old[1] += chars * w
                            old[2] += linked * w
                            old[3] |= noise
                            old[4] |= role
                cols = [*(zip(*counts) if counts else [[]] * 4), *(zip(*counts.values()) if counts else [[]] * 7)]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, _COUNTS.values())], list(_COUNTS))

    p = _pages(pages, page_col, url_col)
    often = cut(p.groupBy("copies").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    p = p.select("host", "page", "copies")
    if often.count() <= BROADCAST_COPIES:
        p = p.join(F.broadcast(often), "copies", "left")
    else:
        p = spread_join(p, often, "copies", hot_keys(p, "copies"), "left")
    p = p.select("host", (F.lit(1.0) / F.coalesce("k", F.lit(1))).alias("w"), "page")
    counted = p.mapInArrow(run, "host long, kind string, path long, value long, n double, chars double, linked double, noise boolean, role boolean, heading boolean, chain array<long>")
    return counted.groupBy("host", "kind", "path", "value").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "linked")], F.max("noise").alias("noise"), F.max("role").alias("role"), F.max("heading").alias("heading"), F.min("chain").alias("chain"))


def unbelieved(counts: DataFrame) -> DataFrame:
    """(host, keep): the branch called noise that holds most of the text, of hosts that have next to none elsewhere."""
    mass = counts.where("kind = 'm'").groupBy("host").agg(F.sum("chars").alias("all"), F.sum(F.when(F.col("path") == 0, F.col("chars")).otherwise(0)).alias("clean"), F.max(F.when(F.col("path") != 0, F.struct("chars", "path"))).alias("most"))
    return mass.where((F.col("clean") < CLEAN * F.col("all")) & F.col("most").isNotNull()).select("host", F.col("most.path").alias("keep"))


def nodes(counts: DataFrame) -> DataFrame:
    """A row per host and path with what is its own in its importance, and the factor of what lies below.

    own + factor * sum over children of share(child) * importance(child) is the importance of a node: its evidence,
    weighted by its pages, and the prior."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    n, plogp = F.col("n"), F.col("n") * F.ln("n")
    x = counts.where("kind <> 'm'").groupBy("host", "path").agg(
        of("s", n).alias("m"), of("s", plogp).alias("m_plogp"), of("s", F.lit(1)).alias("styles"), of("t", n).alias("texts"), of("t", plogp).alias("t_plogp"),
        of("t", F.col("chars")).alias("chars"), of("t", F.col("linked")).alias("linked"), of("t", F.col("chars") * F.col("chars") / n).alias("squares"), of("e", n).alias("share"),
        F.max("noise").alias("noise"), F.max("role").alias("role"), F.max("heading").alias("heading"), F.min("chain").alias("chain"))
    x = cut(x.where("chain is not null").withColumn("up", F.when(F.size("chain") > 1, F.element_at("chain", F.greatest(F.size("chain") - 1, F.lit(1)))).otherwise(0)))
    total = counts.where("kind = 'm'").groupBy("host").agg(F.sum("chars").alias("total"))
    holds = x.groupBy("host", "up").agg(F.sum("chars").alias("chars")).join(total, "host").where(F.col("chars") >= HOLDS * F.col("total"))
    hosts = cut(total.join(holds.groupBy("host").agg(F.collect_list("up").alias("holders")), "host", "left"))  # few of a host hold so much
    x = x.join(F.broadcast(hosts), "host", "left") if hosts.count() <= BROADCAST_COPIES else spread_join(x, hosts, "host", hot_keys(x, "host"), "left")

    entropy = lambda m, p: F.when(F.col(m) > 1 + 1e-6, F.least(F.greatest((F.ln(m) - F.col(p) / F.col(m)) / F.ln(m), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    part = F.coalesce(F.arrays_overlap(F.concat(F.array(F.lit(0).cast("long")), F.slice("chain", 1, F.size("chain") - 1)), "holders"), F.lit(False)) | F.col("role")
    mean = F.col("chars") / F.col("texts")
    spread = F.when(F.col("texts") > 1 + 1e-6, F.greatest(F.col("squares") / F.col("texts") / (mean * mean) - 1, F.lit(0.0))).otherwise(0.0)
    bulk = F.when(part | F.col("heading"), 1.0).otherwise(F.least(F.col("chars") / F.col("total") / BULK + spread, F.lit(1.0)))
    content = entropy("texts", "t_plogp") * (1 - F.coalesce(F.col("linked") / F.col("chars"), F.lit(0.0))) * F.coalesce(bulk, F.lit(1.0))
    weight = F.when(F.col("texts") > 0, F.least(F.col("texts") / F.col("m"), F.lit(1.0))).otherwise(0.0)
    decay = F.pow(F.lit(DAMPING), "styles")
    x = cut(x.select("host", "path", "up", "chain", "m", "noise", "role", part.alias("part"), weight.alias("weight"), F.when(weight > 0, content).otherwise(0.0).alias("content"), decay.alias("decay"), entropy("m", "m_plogp").alias("variety"), F.coalesce("share", F.lit(0.0)).alias("share")))
    return _with_elsewhere(x)


def _with_elsewhere(x: DataFrame) -> DataFrame:
    """Adds `elsewhere`: the importance of a path's texts on other hosts, backing off to 1."""
    texts = (F.col("weight") > 0) & ~F.col("part")
    all_hosts = cut(x.where(texts).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("pages"), F.sum(F.col("m") * F.col("content")).alias("mass")).where("n > 1").drop("n"))
    x = x.join(F.broadcast(all_hosts), "path", "left") if all_hosts.count() <= BROADCAST_LOW else spread_join(x, all_hosts, "path", hot_keys(x, "path"), "left")
    others = (F.col("mass") - F.col("m") * F.col("content") + PAGES) / (F.col("pages") - F.col("m") + PAGES)
    return x.withColumn("elsewhere", F.coalesce(F.when(texts, others), F.lit(1.0))).drop("pages", "mass", "part")


def tree(pages: DataFrame, page_col: str = "html", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(host, path, importance, branch, has_text, noise, up: the parent) of the site style trees, branch being the largest importance of the element and those below it; and `unbelieved`."""
    counts = cut(style_counts(pages, page_col, url_col))
    x = cut(nodes(counts))
    each = cut(x.select("host", F.col("path").alias("node"), F.posexplode("chain").alias("at", "path")).withColumn("key", F.struct("host", "path")).drop("host", "path"))
    inner = each.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("inner"))
    x = cut(x.join(inner.select("key.host", "key.path", "inner"), ["host", "path"]))
    prior = F.when(F.col("weight") == 0, 0.0).when(F.col("role"), F.lit(ROLE_PAGES)).otherwise(F.lit(PAGES))  # what has no text of its own is as important as what it holds
    known = F.col("m") / (F.col("m") + prior)
    rest = prior / (F.col("m") + prior) * F.col("elsewhere")
    evidence = F.when(F.col("inner"), (F.col("weight") * F.col("content") + (1 - F.col("decay")) * F.col("variety")) / (F.col("weight") + 1)).otherwise(F.when(F.col("weight") > 0, F.col("content")).otherwise(0.0))
    parts = x.select(F.struct("host", "path").alias("key"), (known * evidence + rest).alias("own"), F.when(F.col("inner"), known * F.col("decay") / (F.col("weight") + 1)).otherwise(0.0).alias("factor"), "m", "share", (F.col("weight") > 0).alias("text"))
    along = spread_join(each, parts, "key", hot_keys(each, "key"))
    # product of factor(a) * share(child of a) / m(a) from each ancestor a down to the node
    below = Window.partitionBy("key.host", "node").orderBy(F.desc("at"))
    step = F.log(F.greatest(F.col("factor") / F.col("m"), F.lit(1e-300)))
    links = F.sum(F.log(F.greatest(F.col("share"), F.lit(1e-300)))).over(below.rowsBetween(Window.unboundedPreceding, -1))
    ways = F.sum(step).over(below) - F.first(step).over(below)
    deep = F.first("own").over(below)
    sums = along.select("key", (deep * F.exp(F.coalesce(links, F.lit(0.0)) + ways)).alias("part"), F.first("text").over(below).alias("text")).groupBy("key").agg(F.sum("part").alias("importance"), F.max("text").alias("has_text"))
    sums = cut(sums)
    up = each.join(sums.select(F.col("key.host").alias("h"), F.col("key.path").alias("p"), "importance"), (F.col("key.host") == F.col("h")) & (F.col("node") == F.col("p")))
    branch = up.groupBy("key").agg(F.max("importance").alias("branch"))
    out = sums.join(branch, "key").select("key.host", "key.path", "importance", "branch", "has_text").join(x.select("host", "path", "noise", "up"), ["host", "path"])
    return out, unbelieved(counts)


def page_paths(p: DataFrame) -> DataFrame:
    """(page_id, host, path) of the elements that each page has."""
    p = small_batches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                rows = [(i, h, x) for i, h, page in zip(*(b.column(k).slice(at, 100).to_pylist() for k in range(3))) for x in {y.path for y in elements(parse(page)) if y.parent}]
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["copies", "host", "path"])

    return p.select("copies", "host", "page").mapInArrow(run, "copies long, host long, path long")


def agreement(pages: DataFrame, page_col: str = "html", url_col: str = "url") -> DataFrame:
    """By host: n_named branches called noise (the topmost), n_low those the tree leaves out, n_both in both; recall and precision of the tree.

    The tree knows no names, so that this measures it against them; a branch inside of another one that counts isn't counted again."""
    nodes_, _ = tree(pages, page_col, url_col)
    x = nodes_.select("host", "path", "up", "noise", (F.col("branch") < THRESHOLD).alias("low"), "has_text")
    over = x.select("host", F.col("path").alias("up"), F.col("noise").alias("up_noise"), F.col("low").alias("up_low"))
    x = x.join(over, ["host", "up"], "left").na.fill(False, ["up_noise", "up_low"]).where("has_text")
    named, low = F.col("noise") & ~F.col("up_noise"), F.col("low") & ~F.col("up_low")
    count = lambda c: F.count(F.when(c, 1))
    # what is low inside of what is called noise, or the other way round, agrees
    x = x.groupBy("host").agg(count(named).alias("n_named"), count(low).alias("n_low"), count(named & F.col("low")).alias("named_low"), count(low & F.col("noise")).alias("low_named"))
    return x.withColumns({"recall": F.when(F.col("n_named") > 0, F.col("named_low") / F.col("n_named")), "precision": F.when(F.col("n_low") > 0, F.col("low_named") / F.col("n_low"))})


def main_text(pages: DataFrame, page_col: str = "html", url_col: str = "url", names: bool = True) -> DataFrame:
    """Adds `text` to the columns page_id and url. Without `names` the tree alone decides."""
    pages = small_batches(pages)
    nodes_, keeps = tree(pages, page_col, url_col)
    low = cut(nodes_.where(F.col("branch") < THRESHOLD).select("host", "path"))
    keeps = cut(keeps)
    p = _pages(pages, page_col, url_col).drop("copies").withColumn("copies", F.xxhash64("host", "page"))
    keep_fits = keeps.count() <= BROADCAST_COPIES
    p = p.join(F.broadcast(keeps), "host", "left") if keep_fits else spread_join(p, keeps, "host", hot_keys(p, "host"), "left")
    widest = low.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (widest[0] or 0) <= LOW_OF_HOST and (widest[1] or 0) <= BROADCAST_LOW:
        lists = low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))  # of a checked size
        p = p.join(F.broadcast(lists), "host", "left")
    else:  # every page gets what of it is low, by key
        has = page_paths(p.dropDuplicates(["copies"])).join(low, ["host", "path"], "left_semi").groupBy("copies").agg(F.collect_set("path").alias("low"))
        p = p.join(has, "copies", "left")
    p = p.select("page_id", "url", "page", "low", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(blocks(parse(page.as_py()), set(low.as_py() or ()), keep.as_py(), names)) for page, low, keep in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return p.mapInArrow(run, "page_id long, url string, text string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
