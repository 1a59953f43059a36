"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by style path (element names with their
classes). For each node of the merged tree two entropies over the host's
different pages tell how much it varies: of its presentation (the sequence of
its children) and of its content. A branch of low importance is cut from every
page of the host, whatever it is called.

What an element is called is a prior: importance is multiplied by it, and it
decides alone where a host has too few different pages for entropies. So an
element that names its role (menus, adverts) goes on any host, one that only
hints at it (forms, share boxes) goes unless its content varies from page to
page, and article and main elements stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywell.llm.common import bound_batches, let, lookup, lower_ascii, materialise

#: Weight of content against presentation in a node's importance.
GAMMA = 0.9
#: A branch is cut if its importance, times its prior, is at most this: of n
#: different pages, n ** LOW or fewer different contents are boilerplate.
LOW = 0.75
#: Different pages of a host that hold a node before its entropies count, and
#: the importance of a node on fewer.
MIN_PAGES, UNKNOWN = 8, 0.9
#: Priors: reader comments, elements that name a role of noise, elements that hint at one, and the rest.
COMMENTS, NAMED, HINTED, PLAIN = 0.0, 0.5, 0.8, 1.0
#: Levels of block elements that a style path tells apart; text below belongs to the last.
DEPTH = 64

# HTML element names, roles and class words by what they say.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody tfoot thead tr ul caption".split()
)
SPACE = set("br td th".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
UNSEEN = set("head script style template noscript select datalist textarea iframe object embed svg canvas audio video map title noembed noframes xmp".split())
IN_HEAD = set("base link meta noscript script style template title".split())
NAMED_TAGS = set("nav header footer aside menu dialog button input label fieldset".split())
HINTED_TAGS = {"form"}
MAIN_TAGS = {"article", "main"}
NAMED_ROLES = set("navigation banner contentinfo complementary alert dialog alertdialog menu menubar toolbar".split())
HINTED_ROLES = {"search", "form"}
COMMENT_WORDS = set("comment comments respond disqus replies".split())
NAMED_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner nav navbar navigation menu"
    " breadcrumb breadcrumbs footer sidebar notice cookie cookies consent gdpr popup modal newsletter subscribe signup"
    " login pagination pager".split()
)
HINTED_WORDS = set("aside copyright form header masthead overlay promo promotion recommended related search share sharing skip social toolbar widget".split())
#: Class names that say what a page has, not what the element is.
NOT_FIRST = set("has no with without".split())
WRAPS, WRAPPED = set("container inner layout outer wrap wrapper".split()), set("article body content main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")




def _ends(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


class Node(NamedTuple):
    tag: str
    path: str
    depth: int
    prior: float
    inner: float  # the prior as from the article or main element that it is in
    main: bool
    seen: bool


class Block(NamedTuple):
    path: str
    text: str
    prior: float
    main: bool


def prior_of_words(value: str) -> float:
    """The least prior that a class or id attribute's names give."""
    least = PLAIN
    for name in value.split():
        words = _WORDS.findall(name)
        if not words or words[0] in NOT_FIRST or (words[-1] in WRAPS and not WRAPPED.isdisjoint(words)):
            continue
        if not COMMENT_WORDS.isdisjoint(words):
            return COMMENTS
        if not NAMED_WORDS.isdisjoint(words):
            least = NAMED
        elif least > HINTED and not HINTED_WORDS.isdisjoint(words):
            least = HINTED
    return least


def _opened(parent: Node, tag: str, attributes: str) -> Node:
    style, main, own = tag, parent.main or tag in MAIN_TAGS, PLAIN
    if tag in NAMED_TAGS and not (tag == "header" and parent.main):  # an article's header holds its headline
        own = NAMED
    elif tag in HINTED_TAGS:
        own = HINTED
    if attributes:
        for name, *value in _NAMES.findall(attributes):
            name, value = name.lower(), html.unescape("".join(value)).lower()
            if name == "class":
                style += "." + ".".join(sorted(value.replace("/", "|").split()))
            if name == "role":
                role = value.strip()
                main |= role in MAIN_TAGS
                own = min(own, NAMED if role in NAMED_ROLES else HINTED if role in HINTED_ROLES else PLAIN)
            elif tag not in ("html", "body", "article", "main") or name == "class" and tag == "article":
                own = min(own, prior_of_words(value))
    inner = own if main and not parent.main else min(parent.inner, own)
    deeper = tag in BLOCK and parent.depth < DEPTH
    return Node(
        tag, f"{parent.path}/{style}" if deeper else parent.path, parent.depth + deeper,
        min(parent.prior, own), inner, main, parent.seen and tag not in UNSEEN)


def _blocks(page: str) -> Iterator[tuple[Node, str]]:
    """The owner and text of every block, in page order; unseen elements have none."""
    stack, text, at = [Node("", "", 0, PLAIN, PLAIN, False, True)], [], 0
    owner = stack[0]
    n = len(page)

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        return joined

    def apart(a: Node, b: Node) -> bool:
        return a.seen != b.seen or a.prior != b.prior or a.inner != b.inner

    while at < n:
        low = page.find("<", at)
        low = n if low < 0 else low
        if low > at:
            if not text:
                owner = stack[-1]
            text.append(page[at:low])
        if low == n:
            break
        m = _TAG.match(page, low)
        if not m:
            text.append("<")
            at = low + 1
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            end = _ends(tag).search(page, at)
            at = page.find(">", end.end()) + 1 if end else n
            at = at or n
            continue
        if tag in SPACE and text:  # what separates nothing is left out
            text.append(" ")
        if not closing and stack[-1].tag == "head" and tag not in IN_HEAD:  # its end tag may be left out
            stack.pop()
        node = None if closing else _opened(stack[-1], tag, attributes)
        # text belongs to one block, and never to elements of different priors at once
        turns = tag in BLOCK or (len(stack) > 1 and apart(stack[-1], stack[-2]) if closing else apart(node, stack[-1]))
        if turns and text:
            if (joined := flush()) and owner.seen:
                yield owner, joined
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if (tag in BLOCK or tag in CLOSES) and stack[-1].seen:
            ends = CLOSES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" and tag in BLOCK or stack[k].tag in ends:
                    del stack[k:]
                elif stack[k].tag in BLOCK:
                    break
            node = _opened(stack[-1], tag, attributes)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    if text and (joined := flush()) and owner.seen:
        yield owner, joined


def parse(page: str) -> list[Block]:
    """The visible blocks of a page.

    Where every article or main element lies in a branch that a prior speaks
    against (a form around the page, a class that names its layout), that
    branch is no reason to lose them: they keep the priors of what is in them.
    """
    found = list(_blocks(page))
    if not any(n.main and n.prior == PLAIN for n, _ in found):
        found = [(n._replace(prior=n.inner) if n.main and n.prior > COMMENTS else n, t) for n, t in found]
    return [Block(n.path, t, n.prior, n.main) for n, t in found]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def nodes_of(blocks: list[Block]) -> list[tuple[str, bool, int]]:
    """(path, inner, feature) of a page's nodes: hashes of contents, and of inner nodes' sequences of children."""
    content: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    for b in blocks:
        content.setdefault(b.path, []).append(b.text)
        parts = b.path.split("/")
        for k in range(2, len(parts)):
            seen = children.setdefault("/".join(parts[:k]), [])
            if not seen or seen[-1] != parts[k]:
                seen.append(parts[k])
    return [(p, False, _hash("\n".join(t))) for p, t in content.items()] + [(p, True, _hash("\n".join(t))) for p, t in children.items()]


_BLOCKS = pa.struct([("path", pa.string()), ("text", pa.string()), ("prior", pa.float64()), ("main", pa.bool_())])
_NODES = pa.struct([("path", pa.string()), ("inner", pa.bool_()), ("feature", pa.int64())])
_PARSED = "host string, page long, blocks array<struct<path:string,text:string,prior:double,main:boolean>>, nodes array<struct<path:string,inner:boolean,feature:bigint>>"


def _lists(rows: list[list[tuple]], of: pa.StructType) -> pa.Array:
    flat = [x for row in rows for x in row]
    fields = [pa.array([x[i] for x in flat], of.field(i).type) for i in range(of.num_fields)]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(of)))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """tw_id, tw_url, host, page (a hash of its blocks), blocks and nodes of every page: each is parsed once."""
    bound_batches(pages.sparkSession)
    types = [to_arrow_type(pages.schema[c].dataType) for c in (id_col, url_col)]
    src = pages.select(
        F.col(id_col).alias("tw_id"), F.col(url_col).alias("tw_url"),
        lower_ascii(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("tw_html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 100):
                b = whole.slice(low, 100)
                blocks = [parse(page.as_py()) for page in b.column(3)]
                hashes = [_hash("\n".join(f"{x.path} {x.text}" for x in page)) for page in blocks]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).cast(types[0]), b.column(1).cast(types[1]), b.column(2), pa.array(hashes, pa.int64()),
                    _lists(blocks, _BLOCKS), _lists([nodes_of(page) for page in blocks], _NODES),
                ], ["tw_id", "tw_url", "host", "page", "blocks", "nodes"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return materialise(src.mapInArrow(run, f"tw_id {kinds[0]}, tw_url {kinds[1]}, {_PARSED}"), "parsed")


def _branches(path: str) -> Column:
    """A path and the paths of all nodes above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of each node of the hosts' merged style trees, from ``parsed`` pages.

    A host's equal pages count once, so that copies are no evidence.
    """
    each = pages.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*").distinct()
    # one host may have a third of all pages: counts are taken by feature first, which spreads it
    n = each.groupBy("host", "path", "inner", "feature").agg(F.count("*").alias("n"))
    own = n.groupBy("host", "path", "inner").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"),
    ).withColumn("entropy", F.when(F.col("pages") > 1, (
        (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages"))).otherwise(1.0))
    own = materialise(own, "entropies")
    # a branch has the mean content importance of all leaves below it
    content = own.where("not inner").select("host", "pages", "entropy", F.explode(_branches("path")).alias("path")).groupBy("host", "path").agg(
        F.max("pages").alias("pages"), (F.sum(F.col("pages") * F.col("entropy")) / F.sum("pages")).alias("content"))
    look = own.where("inner").select("host", "path", F.col("entropy").alias("presentation"))
    both = content.join(look, ["host", "path"], "left")
    weighed = F.when(F.col("presentation").isNull(), F.col("content")).otherwise(
        (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content"))
    return both.select("host", "path", "pages", weighed.alias("importance"))


def verdicts(nodes: DataFrame) -> DataFrame:
    """host, noise, varied: the branches to cut, and the nodes that vary enough to outweigh a hint.

    Only nodes on MIN_PAGES different pages of the host are judged; a branch
    with an important one below is none. A host's arrays hold its style paths.
    """
    known = materialise(nodes.where(F.col("pages") >= MIN_PAGES), "known")
    high = known.where(F.col("importance") > LOW).select("host", F.explode(_branches("path")).alias("path")).distinct()
    noise = known.where(F.col("importance") <= LOW).join(high, ["host", "path"], "left_anti").select("host", "path", F.lit(True).alias("cut"))
    varied = known.where(F.col("importance") * HINTED > LOW).select("host", "path", F.lit(False).alias("cut"))
    return noise.unionByName(varied).groupBy("host").agg(
        F.array_sort(F.collect_set(F.when(F.col("cut"), F.col("path")))).alias("noise"),
        F.array_sort(F.collect_set(F.when(~F.col("cut"), F.col("path")))).alias("varied"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, cut_by_tree, cut_by_role: the main text of every row of ``pages``.

    The last two count the blocks of the page that its host's tree cuts, and
    those that are cut for their role alone. If blocks of article and main
    elements hold at least half of the characters that are left, they are the
    text; else, as where articles are teasers of a story beside them, all that
    are left are.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a newline. A null or empty page has the empty
    text; so has one that holds nothing but cut branches. Pages with a null
    URL or one without ``://`` share the host "". Repeated rows and null ids
    keep their rows; pages of any length are read whole; an empty table gives
    an empty result; other columns are ignored.
    """
    t = parsed(pages, id_col, url_col, html_col)
    found = materialise(verdicts(style_nodes(t)), "verdicts")
    # broadcast if few hosts have verdicts, else one host's pages go to several tasks
    t = lookup(t.select("tw_id", "tw_url", "host", "blocks"), found, "host", "left", limit=100_000)
    none = F.array().cast("array<string>")
    t = t.withColumns({"noise": F.coalesce("noise", none), "varied": F.coalesce("varied", none)})

    def judged(b: Column) -> Column:
        safe = b["main"] & (b["prior"] == PLAIN)
        noisy = F.exists("noise", lambda x: (b["path"] == x) | F.startswith(b["path"], F.concat(x, F.lit("/"))))
        importance = F.when(F.array_contains("varied", b["path"]), 1.0).otherwise(UNKNOWN)
        by = F.when(~safe & noisy, "tree").when(b["prior"] * importance <= LOW, "role").otherwise("")
        return F.struct(b["text"].alias("text"), b["main"].alias("main"), by.alias("by"))

    t = t.select("tw_id", "tw_url", F.transform("blocks", judged).alias("blocks"))
    left = F.filter("blocks", lambda b: b["by"] == "")

    def size(blocks: Column) -> Column:
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))

    def joined(kept: Column) -> Column:
        mostly = 2 * size(F.filter(kept, lambda b: b["main"])) >= size(kept)
        return let(mostly, lambda main_only: F.array_join(
            F.transform(F.filter(kept, lambda b: b["main"] | ~main_only), lambda b: b["text"]), "\n"))

    count = lambda by: F.size(F.filter("blocks", lambda b: b["by"] == by)).cast("long")
    return t.select(
        F.col("tw_id").alias(id_col), F.col("tw_url").alias(url_col), let(left, joined).alias("text"),
        count("tree").alias("cut_by_tree"), count("role").alias("cut_by_role"))
