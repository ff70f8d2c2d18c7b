"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree (Yi, Liu and Li 2003): a node is a path of elements (tag
and first class or id) from the root. Over the pages that have a node, two normalised entropies are aggregated:

* presentation: in how many ways its children are laid out (a node that always looks alike is of no importance);
* content: how widely each of its features is shared. Features are the texts right inside the node and, for an inner node, the
  whole text of its branch, so that what lies below decides on it too. A text that all pages have is of importance 0,
  one that a single page has is of importance 1; a node has the mean over its features as they occur.

Where a host has few pages, a node's importance is drawn, by ``STRENGTH`` pages, towards that of the same path elsewhere: the lesser of
its mean over all hosts and of its importance in one tree of all hosts' pages. The log-odds of the importance, plus what a page itself says of an element (that it is a menu, a form, comments;
that it is the article), tell whether a branch stays: a branch of negative sum is removed, inside an article too.
Where what is left in elements marked as article is at least a quarter of what is left in all, the text is taken from there.

The statistics are counted per task before they are shuffled and hold one row per
(host, node, value), so a host of any size is no single task's work. Nodes are hashes of their paths, so a page of any depth
costs its length only. The table of unimportant nodes is broadcast while it is small; beyond, it is joined by the nodes that a page has.

A page of which the tree would leave nothing keeps what it does not itself call noise.

Defined results: null and empty pages give an empty text; a null or odd url makes the
page part of a nameless host; unclosed and crossing tags are closed as browsers
do; an unfinished tag at the end is dropped. Repeated rows each get their row, and count as pages of their own; a null id is kept. A page
that is alone on its host, with paths that no other host has, is judged by what it says of itself only. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut
from reelstack.llm.tokens import strings

#: A node less important than this is removed, if nothing else speaks for or against it.
MIN_IMPORTANCE = 0.75
#: Number of pages by which a host's node is drawn towards the same node of all hosts.
STRENGTH = 32.0
#: Importance of a node of which nothing is known.
UNKNOWN = 0.9
#: Weight of presentation against content.
PRESENTATION = 0.1
#: Importances are taken to lie between this and one less this.
CLIP = 0.01
#: What an element's own words weigh, in log-odds: it says that it is no content, that it is the article; it lies inside the article.
SAYS_NOISE, SAYS_ARTICLE, INSIDE_ARTICLE = -5.0, 5.0, 1.5
#: The article's text is taken alone if it has this share of the text that is left.
ARTICLE_SHARE = 0.25
#: Unimportant nodes (rows of host, node, log-odds) up to which they are broadcast.
BROADCAST_NODES = 200_000

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math canvas object select option button title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("nav footer aside form dialog head menu".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu topbar breadcrumb breadcrumbs "
    "sidebar aside rail footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget pagination pager skip legal copyright disclaimer".split()
)
#: Words beside which a word of noise in a compound name still says noise.
PLAIN_WORDS = frozenset(
    "site page main top bottom left right inner outer box bar block area wrap wrapper container list item items section slot unit panel group row col column button buttons "
    "link links text content body header head post posts article articles global primary secondary js is has holder zone region module component title thread user users".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in RAW}
_PARTS = re.compile(r"[\s_\d-]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


_MASK = (1 << 64) - 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Open:
    """An open element; ``node`` hashes the path of its block elements, ``digest`` all text below it, ``style`` its children in order."""

    __slots__ = ("tag", "block", "node", "main", "low", "near_p", "digest", "style", "below", "texts", "index")

    def __init__(self, tag: str, node: int, main: bool, low: bool, near_p: int, index: int):
        self.tag, self.node, self.main, self.low, self.near_p, self.index = tag, node, main, low, near_p, index
        self.block, self.digest, self.style, self.below, self.texts = self, 0, 0, False, []


def _attributes(text: str) -> dict[str, str]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if "=" in text else {}
    return found | ({"hidden": ""} if re.search(r"\bhidden\b", text) and "hidden" not in found and "=" not in text else {})


def _is_noise(tag: str, attr: dict[str, str], inside_main: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not inside_main:
        return True
    if not attr:
        return False
    if attr.get("role", "").lower() in NOISE_ROLES or "hidden" in attr or attr.get("aria-hidden") == "true":
        return True
    if "style" in attr and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attr["style"], re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    # one word of a compound name says nothing where another gives it a subject: social-history, legal-analysis
    for name in f"{attr.get('class', '')} {attr.get('id', '')}".lower().split():
        parts = [w for w in _PARTS.split(name) if w]
        if any(w in NOISE_WORDS for w in parts) and all(w in NOISE_WORDS or w in PLAIN_WORDS for w in parts):
            return True
    return False


@lru_cache(maxsize=1 << 14)
def _says(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool, int]:
    """What an element's tag and attributes say: whether it is marked as article, whether it is named as noise, and its label's hash."""
    attr = _attributes(attributes) if attributes else {}
    marked = tag in ("article", "main") or attr.get("role") == "main" or attr.get("itemprop") == "articleBody"
    noise = _is_noise(tag, attr, (inside_main or marked) and tag != "article")
    name = (attr.get("class", "").split() or attr.get("id", "").split() or [""])[0]
    return marked, noise, _hash(f"{tag}.{name}" if name else tag) | 1


def parse(page: str, odds: dict[int, float] | None = None) -> tuple[list[tuple[int, bool, bool, str]], list[tuple[int, int, set[int]]]]:
    """(blocks, nodes) of a page: each block's (node, removed, in the marked article, text) in page order, and each element's (node, style, features).

    ``odds``: log-odds of the nodes of little importance; others count as important. Every step costs the same at any depth.
    """
    odds = odds or {}
    out: list[tuple[int, bool, bool, str]] = []
    nodes: list[tuple[int, int, set[int]]] = []
    stack = [_Open("", 0, False, False, -1, 0)]
    places: dict[str, list[int]] = {}  # where elements of a tag are open
    pieces: list[str] = []

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            top = stack[-1]
            block = top.block
            h = _hash(text)
            block.texts.append(h)
            block.digest = (block.digest * 31 + h) & _MASK
            out.append((block.node, top.low, top.main, text))

    def close(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            places[done.tag].pop()
            if done.block is done:
                if done.digest:
                    above = stack[-1].block
                    above.digest, above.below = (above.digest * 31 + done.digest) & _MASK, True
                    features = set(done.texts)
                    if done.below:
                        features.add(done.digest)
                    nodes.append((done.node, done.style, features))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            pieces.append(html.unescape(page[at:]))
            break
        if lt > at:
            pieces.append(html.unescape(page[at:lt]))
        m = _TOKEN.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                if page[lt + 1] != "/" or page.find(">", lt) < 0:
                    break
                at = page.find(">", lt) + 1
                continue
            pieces.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                pieces.append(" ")
            if tag not in VOID and (depth := last(tag)):
                # a block element is closed with it if the innermost block lies at or behind it
                if stack[-1].block.index >= depth:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                if stack[-1].near_p > 0:
                    close(stack[-1].near_p)
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                depth = last(*same, "ul", "ol", "dl", "table", "tr")
                if depth and stack[depth].tag in same:
                    close(depth)
        if tag in VOID:
            continue
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        parent, index = stack[-1], len(stack)
        marked, noise, h = _says(tag, m[3], parent.main)
        main = parent.main or marked
        score = (SAYS_ARTICLE if marked else INSIDE_ARTICLE if main else 0.0) + (SAYS_NOISE if noise else 0.0)
        if tag in INLINE:
            new = _Open(tag, parent.node, main, parent.low or score < 0, parent.near_p, index)
            new.block = parent.block
        else:
            node = (parent.block.node * 0x9E3779B97F4A7C15 + h) & _MASK
            parent.block.style = (parent.block.style * 31 + h) & _MASK
            new = _Open(tag, node, main, parent.low or score + odds.get(node, 0.0) < 0, index if tag == "p" else -1, index)
        places.setdefault(tag, []).append(index)
        stack.append(new)
    flush()
    close(1)
    return out, nodes


def main_text(page: str | None, odds: dict[int, float] | None = None) -> str:
    """Main text of one page; ``odds`` are the log-odds of its host's nodes of little importance."""
    if not page:
        return ""
    left = [b for b in parse(page, odds)[0] if not b[1]]
    if odds and not left:
        # a page is not all noise: one that its host repeats whole is judged by what it says of itself
        left = [b for b in parse(page)[0] if not b[1]]
    marked = [b for b in left if b[2]]
    if marked and sum(len(b[3]) for b in marked) >= ARTICLE_SHARE * sum(len(b[3]) for b in left):
        left = marked
    return "\n\n".join(b[3] for b in left)


def style_tree(pages: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(host, node, pages, presentation, content, importance) of a table (host, html): the merged trees' nodes that hold text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                if not page:
                    continue
                # each value of a node counts once a page
                here: set = set()
                for node, style, features in parse(page)[1]:
                    here.add((node, 0, 0))
                    here.add((node, 1, style))
                    here.update((node, 2, f) for f in features)
                for key in here:
                    seen[host, *key] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([_signed(k[1]) for k in keys], pa.int64()),
                    pa.array([k[2] for k in keys], pa.int32()),
                    pa.array([_signed(k[3]) for k in keys], pa.int64()),
                    pa.array([seen[k] for k in keys], pa.int64()),
                ],
                names=["host", "node", "kind", "value", "n"],
            )

    values = pages.mapInArrow(run, "host string, node long, kind int, value long, n long")
    values = cut(values.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n")))
    node = cut(_importance(values, "host", "node"))
    weight = F.col("pages") - 1
    sums = node.groupBy("node").agg(F.sum(F.col("own") * weight).alias("sum"), F.sum(weight).alias("weight"))
    pooled = _importance(values.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")), "node").select("node", F.col("pages").alias("all_pages"), F.col("own").alias("pooled"))
    joined = node.join(sums.join(pooled, "node"), "node")
    # what other hosts tell: a path that no other host has is not judged by its own pages twice (least passes over nulls)
    mean = (F.coalesce("sum", F.lit(0.0)) - F.coalesce(F.col("own") * weight, F.lit(0.0)) + strength * UNKNOWN) / F.nullif(F.col("weight") - weight + strength, F.lit(0.0))
    elsewhere = F.coalesce(F.least(mean, F.when(F.col("all_pages") > F.col("pages"), F.col("pooled"))), F.lit(UNKNOWN))
    shrunk = (F.coalesce(F.col("own"), F.lit(0.0)) * weight + strength * elsewhere) / (weight + strength)
    return joined.select("host", "node", "pages", "presentation", "content", shrunk.alias("importance"))


def _importance(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, pages, presentation, content, own) of a tree's nodes from counts of values (keys, kind, value, n); null where one page tells nothing."""
    of = lambda kind, expr: F.when(F.col("kind") == kind, expr)
    node = values.groupBy(*keys).agg(
        F.max(of(0, F.col("n"))).alias("pages"),
        F.sum(of(1, F.col("n"))).alias("styles"),
        F.sum(of(1, F.col("n") * F.log("n"))).alias("style_logs"),
        F.bool_or(of(1, F.col("value") != 0)).alias("inner"),
        F.sum(of(2, F.col("n"))).alias("features"),
        F.sum(of(2, F.col("n") * F.log("n"))).alias("feature_logs"),
    )
    many = F.col("pages") > 1
    # entropies in units of the logarithm of the number of pages; a leaf has no presentation
    between = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    shown = F.when(many & F.col("inner"), between((F.log("styles") - F.col("style_logs") / F.col("styles")) / F.log("pages")))
    held = F.when(many, between(1 - F.col("feature_logs") / (F.col("features") * F.log("pages"))))
    node = node.select(*keys, "pages", shown.alias("presentation"), held.alias("content"))
    return node.withColumn("own", F.coalesce(PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * F.col("content"), F.col("content")))


def log_odds(importance: str, least: float):
    p = F.least(F.greatest(F.col(importance), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(p / (1 - p)) - F.log(F.lit(least / (1 - least)))


def _nodes_of(pages: DataFrame) -> DataFrame:
    """(host, digest, node) of each distinct page (host, html, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, d, _signed(n)) for h, page, d in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True) if page for n in {x[0] for x in parse(page)[1]}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "digest", "node"])

    return pages.mapInArrow(run, "host string, digest string, node long").distinct()


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_importance: float = MIN_IMPORTANCE,
    strength: float = STRENGTH,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (blocks joined by an empty line) and ``n_chars``, its code points."""
    spark = pages.sparkSession
    slim = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.col(html_col).cast("string").alias("html"),
        F.coalesce(F.lower(F.regexp_extract(F.col(url_col), _HOST, 1)), F.lit("")).alias("host"),
    )
    tree = style_tree(slim.select("host", "html"), strength).withColumn("odds", log_odds("importance", min_importance))
    low = cut(tree.where("odds < 0").select("host", "node", "odds"))
    kind = slim.schema["id"].dataType.simpleString()
    named = f"id {kind}, url string, text string, n_chars long"

    def batch_of(batch: pa.RecordBatch, odds) -> pa.RecordBatch:
        texts = [main_text(page, o) for page, o in zip(strings(batch.column(2)), odds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    if low.count() <= broadcast_nodes:
        by_host: dict[str, dict[int, float]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r["host"], {})[r["node"] & _MASK] = r["odds"]
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch_of(batch, [shared.value.get(h) for h in batch.column(3).to_pylist()])

        return slim.mapInArrow(run, named).withColumnRenamed("id", id_col)

    # a page's own nodes only: no page waits for all nodes of its host
    keyed = slim.withColumn("digest", F.md5(F.col("html").cast("binary")))
    gone = _nodes_of(keyed.select("host", "html", "digest")).join(low, ["host", "node"]).groupBy("host", "digest").agg(F.collect_list(F.struct("node", "odds")).alias("low"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(batch, [{x["node"] & _MASK: x["odds"] for x in low or ()} for low in batch.column(3).to_pylist()])

    return keyed.join(gone, ["host", "digest"], "left").select("id", "url", "html", "low").mapInArrow(run_joined, named).withColumnRenamed("id", id_col)
