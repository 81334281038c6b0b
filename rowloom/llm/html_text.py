"""Main text of web pages by removing site templates.

Each page is parsed to a tree and every element's subtree is hashed. Spark counts the different bodies (marked article,
or else page) with each hash for each host, so that copies of a page count once; subtrees that recur on many of a host's
pages are its template and are deleted when the pages are read again. A share of the pages can hold only so many
subtrees, so a host's list is bounded by its mean page. Scripts, forms, menus and such go by their tags and roles, and
elements whose whole class or id says so (``ad``, ``comments``); all else is left to the counts. Where a page marks its
article and that holds its text, only the article is kept; in it, paragraphs, headings and inline elements stay however
often they recur, and other blocks go only if they recur in most of the host's different articles.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shuffle_partitions, table, tune

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Elements whose inline elements are parts of their text.
RUNS = frozenset("p h1 h2 h3 h4 h5 h6 li dd td pre blockquote".split())
NEVER = frozenset("head script style noscript template iframe nav footer aside form button select textarea input svg canvas object embed menu dialog title xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Whole classes and ids of elements that aren't main text.
CLASSES = frozenset("ad ads advert advertisement banner cookies newsletter sidebar menu navbar breadcrumbs footer comments disqus".split())
#: Parts of classes and ids: a name made of these and at least one of GUESSES is believed outside of articles where a host has too few pages to count.
GUESSES = CLASSES | frozenset("ads advertising sponsor sponsored promo cookie consent gdpr notice popup modal subscribe nav navigation breadcrumb masthead comment share sharing social related recommended widget pagination".split())
NEUTRAL = GUESSES | frozenset("area bar block box button buttons container links list main posts section site top wrapper".split())
#: Blocks in an article that stay however often they recur.
STAY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre caption figcaption legend summary".split())


#: Stands for a whole page among the numbers of subtrees.
WHOLE = 0


class Node:
    __slots__ = ("attributes", "children", "digest", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], b""


def parse(text: str) -> Node:
    """A tree of elements and texts. End tags close the nearest such element; blocks close an open paragraph, items their kind."""
    root = Node("")
    open_, at = [root], 0
    while m := TOKEN.match(text, at):
        at = m.end()
        if m[4] is not None:
            open_[-1].children.append(m[4])
        elif m[2] is None:
            continue
        elif m[1]:
            tag = m[2].lower()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
        else:
            tag = m[2].lower()
            while len(open_) > 1:
                k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag in CLOSES or open_[k].tag in BLOCK), 0)
                if k and tag in CLOSES.get(open_[k].tag, ()):
                    del open_[k:]
                else:
                    break
            node = Node(tag, m[3])
            open_[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                node.children.append(text[at : end.start() if end else len(text)])
                at = end.end() if end else len(text)
            elif tag not in VOID and not m[3].endswith("/"):
                open_.append(node)
        if at >= len(text):
            break
    return root


def walk(node: Node):
    """All elements below, children first, without recursion (pages can be nested deeply)."""
    stack = [(node, iter(node.children))]
    while stack:
        top, rest = stack[-1]
        for c in rest:
            if isinstance(c, Node):
                stack.append((c, iter(c.children)))
                break
        else:
            stack.pop()
            if stack:
                yield top


def hashed(root: Node) -> Node:
    for n in walk(root):
        h = xxhash.xxh3_64(n.tag.encode())
        for c in n.children:
            h.update(c.digest if isinstance(c, Node) else b"\0" + " ".join(c.split()).encode(errors="replace"))
        n.digest = h.digest()
    return root


def countable(root: Node):
    """The elements that counts can decide about: not those that go or stay in any case."""
    stack = [root]
    while stack:
        top = stack.pop()
        for c in top.children:
            if isinstance(c, Node) and not dropped(c, True) and not (top.tag in RUNS and c.tag not in BLOCK):
                yield c
                stack.append(c)


def number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def host(url: str) -> Column:
    """The host of a URL column; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def dropped(node: Node, in_article: bool, guess: bool = False) -> bool:
    if node.tag in NEVER or node.tag == "header" and not in_article:
        return True
    if not node.attributes:
        return False
    got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(node.attributes)}
    if node.tag in ("html", "body", "article", "main"):
        return False
    marks = {*got.get("class", "").split(), got.get("id", "")}
    if guess and not in_article and any(parts & GUESSES and parts <= NEUTRAL for m in marks if (parts := set(re.split("[_-]+", m)))):
        return True
    return bool(marks & CLASSES) or got.get("role") in ROLES


def articles(root: Node, guess: bool = False) -> list[Node]:
    """The outermost article elements, or else main ones, that aren't within dropped ones."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in found:
            found[n.tag].append(n)
            if n.tag == "article":
                continue
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and not dropped(c, False, guess)]
    return found["article"] or found["main"] or [root]


def body(root: Node) -> int:
    """A number for what a page says: equal for copies of an article, whatever surrounds it."""
    return number(xxhash.xxh3_64_digest(b"".join(a.digest for a in articles(root))))


def text_of(parts: list[Node], inside: bool, gone: frozenset[int], guess: bool = False) -> str:
    """The text of some subtrees, a line for each block, without subtrees in ``gone``; ``inside``: of a marked article."""
    blocks: list[list[str]] = [[]]
    for part in parts:
        blocks.append([])
        stack: list = [iter(part.children)]
        tags = [part.tag]
        while stack:
            for c in stack[-1]:
                if not isinstance(c, Node):
                    blocks[-1].append(c)
                elif c.tag == "br":
                    blocks[-1].append(" ")
                elif dropped(c, inside, guess):
                    continue
                elif number(c.digest) in gone and (c.tag in BLOCK and c.tag not in STAY if inside else not (tags[-1] in RUNS and c.tag not in BLOCK)):
                    continue
                else:
                    if c.tag in BLOCK:
                        blocks.append([])
                    stack.append(iter(c.children))
                    tags.append(c.tag)
                    break
            else:
                stack.pop()
                if tags.pop() in BLOCK:
                    blocks.append([])
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape("".join(b)).split())))


def main_text(root: Node, template: frozenset[int], often: frozenset[int] = frozenset(), guess: bool = False) -> str:
    """The marked article's text, unless it is a small part of what the page has: one article below a tenth, several (cards) below half."""
    parts = articles(root, guess)
    if parts == [root]:
        return text_of(parts, False, template, guess)
    inside = text_of(parts, True, often)
    whole = text_of([root], False, template, guess)
    return inside if len(inside) * (10 if len(parts) == 1 else 2) >= len(whole) else whole


#: Bytes of pages that one task reads, about: an even share of them between these bounds. Hosts with more are dealt to several tasks.
TASK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text", share: float = 0.1, article_share: float = 0.5, least_pages: int = 5) -> DataFrame:
    """Adds the main text (empty if none) to every page; other columns stay, whatever their names, but for an older one of its name.

    A subtree on more than ``share`` of a host's different pages, ``least_pages`` at least, is template, but for inline
    parts of a paragraph or its like; in a marked article, ``article_share`` is needed, and paragraphs and headings stay.
    Null or empty html gives an empty text, null or odd urls share one empty host, copies count as one page, repeated
    rows each get a row. Very long pages are read whole. An empty table gives no rows.
    """
    tune(pages.sparkSession)
    kept = [c for c in pages.columns if c != out]

    def subtrees(batches):
        for b in batches:
            hosts, digests, bodies = [], [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root = parse(text or "")
                found = {number(n.digest) for n in countable(hashed(root))}
                root.digest = xxhash.xxh3_64_digest(b"".join(c.digest if isinstance(c, Node) else c.encode(errors="replace") for c in root.children))
                found.add(WHOLE)
                hosts += [name] * len(found)
                digests += found
                bodies += [body(root)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(bodies, pa.int64())], names=["host", "digest", "body"])

    found = pages.select(host(url_col), html_col).mapInArrow(subtrees, "host string, digest bigint, body bigint").distinct()  # by body, too, so that a host's commonest subtree is spread
    counts = materialize(found.groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages), "subtrees")
    different = counts.filter(F.col("digest") == WHOLE).select("host", F.col("n").alias("different"))
    recurring = counts.filter(F.col("digest") != WHOLE).join(different, "host").filter(F.col("n") > share * F.col("different"))
    lists = recurring.groupBy("host").agg(F.first(F.col("different") * share >= least_pages).alias("many"), F.collect_list("digest").alias("template"), F.collect_list(F.when(F.col("n") > article_share * F.col("different"), F.col("digest"))).alias("often"))

    sizes = pages.select(host(url_col).alias("host"), F.coalesce(F.length(html_col), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes.groupBy("host").agg((F.sum("size") + 200 * F.count("*")).alias("size")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = min(TASK_BYTES, max(LEAST_BYTES, total // shuffle_partitions(pages.sparkSession)))
    hot = F.broadcast(sizes.filter(F.col("size") > each).select("host", F.ceil(F.col("size") / each).alias("parts")))  # a row for each share of pages at most
    page = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = pages.select(page, host(url_col).alias("host")).join(hot, "host", "left").select("host", F.pmod(F.monotonically_increasing_id(), parts).alias("part"), "page", F.lit(None).cast("array<bigint>").alias("template"), F.lit(None).cast("array<bigint>").alias("often"), F.lit(None).cast("boolean").alias("many"))
    listed = lists.join(hot, "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast(dealt.schema["page"].dataType).alias("page"), "template", "often", "many")
    # a host's lists come before its pages
    rows = dealt.unionByName(listed).repartition(max(1, -(-total // each)), "host", "part").sortWithinPartitions("host", "part", F.col("page").isNotNull())
    at = kept.index(html_col)

    def texts(batches):
        now, template, often, guess = None, frozenset(), frozenset(), True
        for b in batches:
            mine, found, places = b.column("page"), [], []
            values = mine.field(at).to_pylist()
            for k, (key, there, first, second, many) in enumerate(zip(zip(b.column("host").to_pylist(), b.column("part").to_pylist(), strict=True), mine.is_valid().to_pylist(), b.column("template").to_pylist(), b.column("often").to_pylist(), b.column("many").to_pylist(), strict=True)):
                if key != now:
                    now, template, often, guess = key, frozenset(), frozenset(), True
                if there:
                    places.append(k)
                    found.append(main_text(hashed(parse(values[k] or "")), template, often, guess))
                else:
                    template, often, guess = frozenset(first), frozenset(second), not many
            left = mine.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.flatten(), pa.array(found, pa.string())], names=[*kept, out])

    return rows.select("host", "part", "page", "template", "often", "many").mapInArrow(texts, T.StructType([*(pages.schema[c] for c in kept), T.StructField(out, T.StringType())]))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
