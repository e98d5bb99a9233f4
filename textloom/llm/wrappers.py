"""Operator 10: HTML extraction by wrapper induction.

All pages of a host are parsed and the digests of their blocks are counted, pages of equal content once. Pages of which
NEAR_SHARE of the content is on nearly all pages are near copies of one article and count once more together: what they
share is no template. Blocks on nearly all of the articles left are constant. A bounded number of these articles (PAGES,
those with the smallest hashes of their html) is aligned for the path: their DOM trees of block elements, in which runs of
equal siblings are merged, by simple tree matching, the largest set of node pairs that keeps order and ancestry (of very
many children only those near the same relative place). Aligned
nodes whose text is constant are template, those whose text varies are content slots. The wrapper of a host is the path to
the article or main element, without these to the lowest node that holds all varying text, outside menus, headers, footers,
sidebars, adverts, forms and comments by their element names, roles and class names, and the digests of the constant
blocks. It is then applied to every page of the host: constant blocks go, except where they are NEAR_SHARE of what the path
leads to, and where a page has other text beside the path, its end moves up. Hosts with fewer than MIN_PAGES articles have no
wrapper; they, and pages without the wrapper's path, fall back to all article or main elements or else to the whole page.

Defined results: null, empty or markup-free html gives its text as one page without template (the empty string if none);
unclosed elements end with their parent; names (class, id) never mark headings, and inside an article or main element only
containers all of whose words are marks or say nothing more; header elements go there, too; formulas are text;
attributes follow the HTML standard; elements nested deeper than MAX_DEPTH lie side by side; html, body, main and article are never boilerplate, nor
are forms and containers with a boilerplate name that hold most of the page's text while no article is beside them; a page
of which nothing is left is read without such names, roles and forms; a page cut inside a tag or comment loses that tag or comment; character
references are decoded once; blocks are separated by one line feed and white space is [\\x20\\x09-\\x0D]; a null url has the
empty host; repeated rows are extracted as given; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import load, materialize, with_arrow_columns
from textloom.llm.url_filter import host_of

PAGES, MIN_PAGES, CONSTANT_SHARE, NEAR_SHARE, MAX_DEPTH = 8, 3, 0.8, 0.6, 200
BROADCAST_BYTES, BROADCAST_HOSTS = 8 << 20, 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Left out with all that they hold.
SKIPPED = frozenset("template object svg annotation annotation-xml select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav header footer aside form menu dialog search button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header hidden "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related reply replies respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these, the words that mark an inline element as well.
INLINE_MARKS = frozenset("ad ads advert adverts advertisement promo promoted sponsor sponsored".split())
#: Never boilerplate by class, id or role: they hold the page or its article.
HOLDERS = frozenset("html body main article".split())
#: A block element that starts closes an open one of these.
CLOSES_P = BLOCKS - {"html", "body", "head"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"optgroup"}}

#: Names of these blocks never mark them; inside an article or main element, nor do those of PARTS.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p li td th tr dt dd pre blockquote caption figcaption table tbody thead tfoot ul ol dl".split())
#: Words beside MARKS in names that still say no more than the mark: inside an article a name counts by all of its words.
PLAIN = frozenset("area bar block body box button buttons container content inner item items left links list main outer page panel post posts right section site slot the title top unit wrap wrapper".split())
#: Blocks of running text: their ids, often made from their text, tell nothing about the page's form.
LEAVES = PARTS | HEADINGS | {"address", "legend", "option", "summary"}
#: Pairs of children that are compared at most; beyond them, only those near the same relative place.
PAIRS = 200_000

# attributes: a name, and perhaps a value in quotes or up to white space; a quote that is never closed is part of a name
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+|=)*+)(?:(>)|\Z)|<[a-zA-Z/]\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+")
#: The end of a raw element, whose content is no markup: its end tag or the end of the page.
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?|\Z", re.I) for tag in RAW}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """A block element: items holds its texts and block children in page order."""

    __slots__ = ("bad", "inside", "items", "key", "size", "tag")

    def __init__(self, tag: str, key: str = "", bad: bool = False, inside: bool = False):
        self.tag, self.key, self.bad, self.inside, self.items, self.size = tag, key, bad, inside, [], 0

    @property
    def sign(self) -> str:
        return f"{self.tag}.{self.key}"


def _named(value: str, words: frozenset[str], whole: bool) -> bool:
    """Whether a class or id holds a marking word; whole: a name whose words are all marks or say nothing more."""
    if not whole:
        return any(w in words for w in re.split(r"[^a-z]+", value))
    for name in value.split():
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in words for w in parts) and all(w in words or w in PLAIN for w in parts):
            return True
    return False


def _traits(attributes: str, tag: str, words: frozenset[str] = MARKS, inside: bool = False) -> tuple[str, bool]:
    """Class and id for matching, and whether names or the role mark boilerplate."""
    key, bad, seen = "", False, set()
    unnamed = tag in HEADINGS or (inside and tag in PARTS)
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            key += quote(value) if name == "class" or tag not in LEAVES else ""
            bad |= not unnamed and _named(value, words, inside)
        elif name == "role":
            bad |= value in ROLES
        elif name in ("hidden", "aria-hidden"):
            bad |= name == "hidden" or value == "true"
    return key, bad


def _measure(node: Node) -> int:
    """Sets the size of each node: the characters of text below it, heads left out."""
    for item in node.items:
        if isinstance(item, str):
            node.size += len(item.strip())
        else:
            size = _measure(item)
            node.size += size if item.tag != "head" else 0
    return node.size


def _has_article(node: Node) -> bool:
    return any(not i.bad and (i.tag in ("article", "main") or _has_article(i)) for i in node.items if isinstance(i, Node))


def _unmark(root: Node) -> None:
    """Forms and containers marked by a name or role count as unmarked where they hold most of the page's text, if no article is beside them."""
    total, at = _measure(root), root
    alone = not _has_article(root)
    while at and alone:
        at = next((i for i in at.items if isinstance(i, Node) and i.tag != "head" and 2 * i.size > total), None)
        if at and at.bad and (at.tag in ("form", "fieldset") or at.tag not in BOILERPLATE):
            at.bad = False
            alone = not _has_article(root)


def parse(html: str, marks: bool = True) -> Node:
    """The page's tree of blocks; without marks only element names other than form and fieldset tell boilerplate."""
    root = _tree(html, marks)
    if marks:
        _unmark(root)
    return root


def _tree(html: str, marks: bool) -> Node:
    root = Node("#")
    stack, deep, at, skip, inside, resume, unclosed = [root], [], 0, "", 0, 0, set()
    while (m := _TOKEN.search(html, at)) or skip:
        if not m:  # what should be skipped has no end: read on after its start
            unclosed.add(skip)
            at, skip = resume, ""
            continue
        if not skip and m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # no tag, or one that the page ends in
            continue
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title"):
                at = _END[tag].search(html, at).end()
            continue
        if skip:
            if tag == skip and not m[3].rstrip().endswith("/"):
                inside += -1 if m[1] else 1
                skip = skip if inside else ""
            continue
        if m[1]:
            if tag in deep:
                while deep.pop() != tag:
                    pass
            elif tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
            continue
        if tag == "br":
            stack[-1].items.append("\n")
        if tag not in BLOCKS:
            key, bad = _traits(m[3], tag, INLINE_MARKS, stack[-1].inside) if m[3] and marks and tag not in VOID else ("", False)
            if (tag in SKIPPED or (bad and tag in ("span", "ins"))) and tag not in unclosed and not m[3].rstrip().endswith("/"):
                skip, inside, resume = tag, 1, at
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in ITEMS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ITEMS[tag]:
                    break
                if stack[depth].tag == tag or {stack[depth].tag, tag} in ({"dt", "dd"}, {"td", "th"}):
                    del stack[depth:]
                    break
        if tag in VOID:
            stack[-1].items.append(Node(tag))
            continue
        inside = stack[-1].inside or tag in ("article", "main")
        key, bad = _traits(m[3], tag, inside=inside) if m[3] else ("", False)
        bad = bad and marks and tag not in HOLDERS
        node = Node(tag, key, bad or (tag in BOILERPLATE and (marks or tag not in ("form", "fieldset"))), inside)
        stack[-1].items.append(node)
        if len(stack) < MAX_DEPTH or (node.bad and not stack[-1].bad):
            stack.append(node)
        else:
            deep.append(tag)
    if at < len(html):
        stack[-1].items.append(html[at:])
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below node, without boilerplate."""
    out: list[str] = []

    def visit(x: Node) -> None:
        held: list[str] = []

        def flush() -> None:
            if held:
                text = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip(" ")
                if text:
                    out.append(text)
                held.clear()

        for item in x.items:
            if isinstance(item, str):
                held.append(item)
            else:
                flush()
                if not item.bad:
                    visit(item)
        flush()

    visit(node)
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Shape:
    """A node of the tree that is aligned: a run of equal siblings as one, with the own texts of all of the run."""

    __slots__ = ("children", "others", "own", "sign", "size", "texts")

    def __init__(self, sign: str):
        self.sign, self.children, self.own, self.size, self.texts, self.others = sign, [], [], 0, [], []

    @property
    def tag(self) -> str:
        return self.sign.split(".")[0]

    def all_texts(self) -> list[str]:
        return self.own + [t for c in self.children for t in c.all_texts()]


def shape(nodes: list[Node]) -> Shape:
    out = Shape(nodes[0].sign)
    below: list[Node] = []
    for n in nodes:
        alone = Node(n.tag)
        alone.items = [i if isinstance(i, str) else Node("hr") for i in n.items]
        out.own += blocks(alone)
        below += [i for i in n.items if isinstance(i, Node) and not i.bad]
    runs: list[list[Node]] = []
    for n in below:
        if runs and runs[-1][0].sign == n.sign:
            runs[-1].append(n)
        else:
            runs.append([n])
    out.children = [shape(r) for r in runs]
    out.size = sum(map(len, out.own)) + sum(c.size for c in out.children)
    out.texts = [out.own]
    return out


def simple_tree_matching(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """The size of the largest order-keeping match of two trees with equal roots, and the matched nodes."""
    if a.sign != b.sign:
        return 0, []
    matched, weight = [(a, b)], 0
    for size, pairs in _in_order(a.children, b.children):
        weight += size
        matched += pairs
    return weight + 1, matched


def _in_order(left: list[Shape], right: list[Shape]) -> list[tuple[int, list[tuple[Shape, Shape]]]]:
    """The matches of children that keep order and have the most nodes in all: only children of equal signs meet, and the
    heaviest rising chain of them is found with a tree of prefix maxima."""
    places: dict[str, list[int]] = {}
    for j, s in enumerate(right):
        places.setdefault(s.sign, []).append(j)
    many = sum(len(places.get(s.sign, ())) for s in left)
    band = len(right) if many <= PAIRS else max(1, PAIRS // len(left) // 2)
    tree: list[tuple[int, tuple | None]] = [(0, None)] * (len(right) + 1)  # weight of the best chain that ends in a stretch, and the chain
    top: tuple[int, tuple | None] = (0, None)
    for i, s in enumerate(left):
        at = places.get(s.sign, ())
        if many > PAIRS:
            centre = i * len(right) // len(left)
            at = at[bisect_left(at, centre - band) : bisect_right(at, centre + band)]
        for j in reversed(at):
            size, pairs = simple_tree_matching(s, right[j])
            before: tuple[int, tuple | None] = (0, None)
            k = j
            while k:
                before = max(before, tree[k], key=lambda x: x[0])
                k &= k - 1
            chain = (before[0] + size, (before[1], size, pairs))
            top = max(top, chain, key=lambda x: x[0])
            k = j + 1
            while k <= len(right):
                tree[k] = max(tree[k], chain, key=lambda x: x[0])
                k += k & -k
    out, at = [], top[1]
    while at:
        out.append((at[1], at[2]))
        at = at[0]
    return out[::-1]


def induce(pages: list[str], template: list[int] | None = None) -> str | None:
    """The wrapper of some pages of a host as JSON: the path to the content and the digests of constant blocks.

    template: the constant blocks of all pages of the host; if not given, they are learned from these pages."""
    shapes = []
    told = set()
    for html in pages:
        s = shape([parse(html)])
        if (key := digest("\n".join(blocks(parse(html))))) not in told:
            told.add(key)
            shapes.append(s)
    if len(shapes) < MIN_PAGES:
        return None
    base = max(shapes, key=lambda s: s.size)
    for other in shapes:
        if other is not base:
            matched = simple_tree_matching(base, other)[1]
            met = {id(theirs) for _, theirs in matched}
            for mine, theirs in matched:
                mine.texts.append(theirs.own)
                mine.others += [t for c in theirs.children if id(c) not in met for t in c.all_texts()]
    enough = max(CONSTANT_SHARE * len(shapes), 2)
    constant = set(template or [])

    def learn(s: Shape) -> None:
        constant.update(digest(t) for t, n in Counter(t for texts in s.texts for t in set(texts)).items() if n >= enough)
        for c in s.children:
            learn(c)

    if template is None:
        learn(base)

    def here(s: Shape) -> int:
        """Characters of the node's own text, and of nodes below it that base has not, that vary between the pages."""
        return sum(len(t) for texts in [*s.texts, s.others] for t in texts if digest(t) not in constant)

    def varying(s: Shape) -> int:
        return here(s) + sum(varying(c) for c in s.children)

    def articles(s: Shape) -> int:
        """Characters that vary in article and main elements."""
        return varying(s) if s.tag in ("article", "main") else sum(articles(c) for c in s.children)

    if not varying(base):
        return None
    path, at = [], base
    while at.children and at.tag not in ("article", "main"):
        marked = [c for c in at.children if c.tag in ("article", "main")]
        if marked:
            best = max(marked, key=varying)
        elif 2 * articles(at) >= varying(at):
            best = max(at.children, key=articles)
        else:  # down only past what is constant, so that the node holds all that varies
            best = max(at.children, key=varying)
            if varying(best) < varying(at):
                break
        if best.tag in ("p", "li", "h1", "h2", "h3", "pre", "td", "ul", "ol", "dl"):
            break
        path.append(best.sign)
        at = best
    return json.dumps([path, sorted(constant)])


def _heaviest(root: Node) -> list[Node]:
    """Where no wrapper fits: all article or main elements, else the body or whatever there is."""
    found: list[Node] = []

    def visit(n: Node) -> None:
        for i in n.items:
            if isinstance(i, Node) and not i.bad:
                if i.tag in ("article", "main"):
                    found.append(i)
                else:
                    visit(i)

    visit(root)
    return found or [root]


def extract(html: str | None, wrapper: str | None = None) -> str:
    if not html:
        return ""
    root = parse(html)
    nodes, constant = [], frozenset()
    if wrapper:
        path, digests = json.loads(wrapper)
        constant = frozenset(digests)
        levels = [[root]]
        for sign in path:
            levels.append([i for n in levels[-1] for i in n.items if isinstance(i, Node) and i.sign == sign and not i.bad])
        nodes = levels.pop() if path else []
        if nodes and nodes[0].tag not in ("article", "main"):
            free = lambda ns: sum(digest(b) not in constant for n in ns for b in blocks(n))
            want = free([root])
            while levels and free(nodes) < want:
                nodes = levels.pop()
    if not blocks(root):
        root, nodes = parse(html, marks=False), []
    if not nodes:
        nodes = _heaviest(root)
    texts = [b for n in nodes for b in blocks(n)]
    kept = [b for b in texts if digest(b) not in constant] if constant else texts
    # of a page that is mostly constant, the constant blocks are the article
    return "\n".join(kept if sum(map(len, kept)) > (1 - NEAR_SHARE) * sum(map(len, texts)) else texts)


def page_blocks(html: str) -> tuple[int, list[int], list[int]]:
    """A digest of the page's content, the digests of all of its blocks, and the length of each in the content (0 outside)."""
    root = parse(html)
    texts = [b for n in _heaviest(root) for b in blocks(n)]
    sizes = dict.fromkeys(map(digest, blocks(root)), 0)
    for t in texts:
        d = digest(t)
        sizes[d] = sizes.get(d, 0) + len(t)
    return digest("\n".join(texts)), list(sizes), list(sizes.values())


def _with_host(rows: DataFrame, hosts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one small row for each host."""
    return rows.join(F.broadcast(hosts) if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else hosts, "host", how)


def _common(seen: DataFrame, weight, name: str) -> tuple[DataFrame, DataFrame]:
    """(host, n): weight of all rows of a host; (host, name): the blocks on nearly all of them, for hosts with MIN_PAGES of them."""
    n = materialize(seen.groupBy("host").agg(weight.alias("n")).filter(F.col("n") >= MIN_PAGES), "host-pages")
    counts = seen.select("host", "near", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(weight.alias("held")).filter("held >= 2")
    most = _with_host(counts, n).filter(F.col("held") >= CONSTANT_SHARE * F.col("n"))
    return n, materialize(most.groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias(name)), name)


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one row for each host with enough unlike pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).filter("html is not null and html <> ''")

    def read(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [page_blocks(h) for h in batch.column("html").to_pylist()]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]

    read_pages = with_arrow_columns(rows, read, {"content": "long", "digests": "array<long>", "sizes": "array<long>"}, drop=("html",))
    once = read_pages.groupBy("host", "content").agg(F.min(F.struct("h", "digests", "sizes")).alias("page"))
    seen = materialize(once.select("host", "content", "page.*", F.lit(False).alias("near")), "page-blocks")
    _, shared = _common(seen, F.count(F.lit(1)), "shared")

    def mostly_shared(batch: pa.RecordBatch) -> list[pa.Array]:
        near = []
        for digests, sizes, shared in zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "shared")), strict=True):
            shared = frozenset(shared or ())
            near.append(bool(shared) and sum(n for d, n in zip(digests, sizes, strict=True) if d in shared) >= NEAR_SHARE * sum(sizes))
        return [pa.array(near, pa.bool_())]

    told = materialize(with_arrow_columns(_with_host(seen, shared, "left"), mostly_shared, {"near": "boolean"}, drop=("sizes", "shared")), "near-copies")
    n, template = _common(told, F.count_if(~F.col("near")) + F.max(F.col("near").cast("int")), "template")

    articles = told.groupBy("host", "near", F.when(~F.col("near"), F.col("content")).alias("article")).agg(F.min("h").alias("h"))
    order = Window.partitionBy("host").orderBy("h", "article")
    # row_number() <= PAGES is limited within each task before the shuffle, so a hot host sends PAGES rows a task
    few = articles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PAGES).select("host", "h")
    few = materialize(_with_host(few, n).drop("n").distinct(), "aligned-pages")
    few = F.broadcast(few) if few.limit(PAGES * BROADCAST_HOSTS + 1).count() <= PAGES * BROADCAST_HOSTS else few
    aligned = rows.join(few, ["host", "h"]).groupBy("host", "h").agg(F.min("html").alias("html")).join(template, "host", "left")

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        constant = part.template.iloc[0]
        wrapper = induce(part.html.tolist(), [] if constant is None else [int(d) for d in constant])
        return pd.DataFrame({"host": part.host.iloc[:1], "wrapper": [wrapper]}).dropna()

    return aligned.groupBy("host").applyInPandas(make, "host string, wrapper string")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text and n_chars; columns of these names are replaced."""
    wrappers = materialize(induce_wrappers(pages, url_col, html_col), "wrappers").withColumnRenamed("host", "_host").withColumnRenamed("wrapper", "_wrapper")
    size = wrappers.agg(F.sum(F.length("_wrapper") + F.length("_host"))).first()[0] or 0
    joined = pages.drop("text", "n_chars").join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, host_of(F.col(url_col)) == F.col("_host"), "left")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [extract(h, w) for h, w in zip(batch.column(html_col).to_pylist(), batch.column("_wrapper").to_pylist(), strict=True)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_arrow_columns(joined, make, {"text": "string", "n_chars": "long"}, drop=("_host", "_wrapper"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
