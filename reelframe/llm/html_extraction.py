"""Main text of web pages with a site style tree.

The containers of a page (body, div, nav, list, article ...) are nodes, named by their path of elements and classes.  The pages of a host are
merged into one tree that counts, for every node, how its pages fill it: the shape (which children, how many, in which order), the
kind of text (how many lines it fills, linked or not) and the text itself.  A node's importance is the entropy of these counts over its
pages, 0 where all pages look alike and 1 where none does: presentation and content are weighed as 1 - g**l and g**l for l shapes.  The same
tree over all hosts stands in where a host has few pages.

A branch goes where its importance is low beside that of the whole page.  What a page says of itself (its article mark, element, role and
class names) only moves that bar: a menu must matter nearly as much as the whole page to stay, unmarked parts half as much, and within an
article only what reads alike on all pages goes.  A class or id name within an article, on an inline element or on the article itself is weak: such a branch goes only
where the tree has seen several pages on which it reads alike.  Elsewhere the names decide where there is no evidence.  Reader comments are
told by name alone: they are as varied as articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, table
from reelframe.llm.url_filters import host_of

# Element names of HTML by what they mean for extraction; every other element is inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas textarea title object audio video".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr tbody thead tfoot td th caption blockquote pre figure figcaption address summary hr html body legend hgroup".split())
CONTAINERS = frozenset("article aside center details dialog dir div dl fieldset footer form head header main menu nav ol search section table ul".split())
CONTROLS = frozenset("button select option optgroup datalist".split())
OFF_ELEMENTS = frozenset("nav footer aside form dialog menu fieldset search".split()) | CONTROLS
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id attributes of branches that are no article wherever they stand, and of those that are none outside an article.
ANYWHERE = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead topbar share sharing social newsletter subscribe subscription pagination pager copyright footer".split()
)
OUTSIDE = frozenset("promotion banner notification notifications overlay aside widget related recommended login signup register search skip toolbar header hidden".split())
COMMENTS = frozenset("comment comments commentlist commentform disqus reply replies respond".split())
MAIN = frozenset(("article", "main"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")
#: Opening one of these ends an open p; the others end their like.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: g; how much the tree of all hosts and the page's own word count beside one more page of the host; words of a line.
GAMMA, POOL, PRIOR, LINE = 0.9, 4.0, 2.0, 16
#: Importance expected of a branch that the page itself sets aside, that lies outside a marked article, and of any other.
EXPECTED_OFF, EXPECTED_OUTSIDE, EXPECTED = 0.0, 0.2, 0.6
#: What the host's tree says of a node, as bits: stays though set aside, stays outside an article, goes where no article is marked, goes within one, goes where a weak name sets it aside.
STAYS_OFF, STAYS_OUTSIDE, GOES, GOES_INSIDE, GOES_WEAK = 1, 2, 4, 8, 16
#: How a branch is set aside: not at all, by a strong name (an element, a role, a class outside articles), for good, by a weak name.
FREE, OFF, NEVER, WEAK = 0, 1, 2, 3
#: Nodes on a smaller share of a host's pages get no verdict, so a host has at most so many verdicts as 1 / SUPPORT pages have containers.
SUPPORT = 0.01


def _role(tag: str, attributes: str, inside: bool, names: bool) -> tuple[int, str]:
    """(how the branch is set aside, name of the node); `inside` says that an article is open, or that the branch is inline."""
    off = OFF if names and (tag in OFF_ELEMENTS or (tag == "header" and not inside)) else FREE
    if not attributes or attributes.isspace():
        return off, tag
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    named = {w for w in _SPLIT.split(f"{found.get('class', '')} {found.get('id', '')}".lower()) if w}
    name = f"{tag}.{'.'.join(sorted(named))}" if named else tag
    if tag in ("html", "body"):
        return FREE, name
    if named & COMMENTS:
        return NEVER, name
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or (names and found.get("role", "").lower() in ROLES):
        off = OFF
    elif off == FREE and names and (named & ANYWHERE or (not inside and named & OUTSIDE)):
        off = WEAK if inside or tag in MAIN else OFF
    return off, name


def _plain(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


class Page:
    """The containers of a page and its blocks of text in order.

    A node is [key, parent, how it is set aside, in an article, names of its children]; a block is a list of [raw text, node, linked characters], more than one where
    an inline branch is a node of its own.  Node 0 is the whole page.  `names` false lets no element, role or class name count but those of comments; `marks` false overlooks article and main.
    """

    def __init__(self, source: str, *, names: bool = True, marks: bool = True):
        self.nodes: list[list] = [[0, 0, FREE, False, []]]
        self.blocks: list[list[list]] = []
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, in an article
        parts: list[list] = []
        anchors = at = 0
        inline: list = []  # an inline branch that names set aside: its tag, open elements of that tag, depth of the stack, node

        def open_node(name: str, off: int, inside: bool) -> int:
            parent = inline[3] if inline else stack[-1][1]
            self.nodes.append([xxhash.xxh64_intdigest(f"{self.nodes[parent][0]}/{name}") >> 1, parent, off, inside, []])
            return len(self.nodes) - 1

        def close_block() -> None:
            if parts:
                self.blocks.append(list(parts))
                parts.clear()

        def add(raw: str, linked: int) -> None:
            node = inline[3] if inline else stack[-1][1]
            if parts and parts[-1][1] == node:
                parts[-1][0] += raw
                parts[-1][2] += linked
            else:
                parts.append([raw, node, linked])

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                add(source[at:stop], stop - at if anchors else 0)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    done = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = done.end() if done else end
                continue
            block = tag in FLOW or tag in CONTAINERS or tag in CONTROLS
            if not block:
                if tag == "br":
                    add(" ", 0)
                elif tag not in VOID:
                    if inline and tag == inline[0]:
                        inline[1] += -1 if m[1] else 1
                        if not inline[1]:
                            inline = []
                    elif not inline and not m[1] and m[3]:
                        off, name = _role(tag, m[3], True, names)
                        if off:
                            inline = [tag, 1, len(stack), open_node(name, off, stack[-1][2])]
                    if tag == "a":
                        anchors = max(0, anchors - 1) if m[1] else 1
                continue
            if m[1]:
                if any(x[0] == tag for x in stack):
                    close_block()
                    anchors = 0
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
                    if inline and len(stack) < inline[2]:
                        inline = []
                continue
            close_block()
            anchors = 0
            if tag == "hr":
                continue
            if tag == "body":
                del stack[1:]
            ends = _ENDS.get(tag, ()) if tag in _ENDS else ("p",)
            open_tags = [x[0] for x in stack]
            for e in ("p", *ends) if tag in _ENDS else ends:
                if e in open_tags:
                    k = len(open_tags) - 1 - open_tags[::-1].index(e)
                    if not any(t in ("table", "ul", "ol", "dl") for t in open_tags[k + 1 :]):
                        del stack[k:]
                        open_tags = open_tags[:k]
            if inline and len(stack) < inline[2]:
                inline = []
            _, node, inside = stack[-1]
            inside = inside or (marks and tag in MAIN)
            off, name = _role(tag, m[3], inside, names)
            if tag not in ("html", "body"):
                self.nodes[inline[3] if inline else node][4].append(name)
            if tag == "head":
                off = NEVER
            if off or tag in CONTAINERS:
                node = open_node(name, off, inside)
            stack.append((tag, node, inside))
        close_block()

    def style(self) -> list[tuple[int, int, int, int]]:
        """(node, shape, kind of text, text) of each node by name, as hashes; nodes of one name on a page count as one."""
        size = len(self.nodes)
        own: list[list[str]] = [[] for _ in range(size)]
        words, linked, chars = [0] * size, [0] * size, [0] * size
        for raw, node, links in (part for block in self.blocks for part in block):
            text = _plain(raw)
            if not text:
                continue
            n = text.count(" ") + 1
            while True:
                own[node].append(text)
                words[node] += n
                linked[node] += links
                chars[node] += len(text)
                if not node:
                    break
                node = self.nodes[node][1]
        found: dict[int, list] = {}
        for i, node in enumerate(self.nodes):
            if node[2] != NEVER:
                found.setdefault(node[0], []).append(i)
        out = []
        for key, which in found.items():
            shape = [f"{name}{len(list(run)).bit_length()}" for i in which for name, run in groupby(self.nodes[i][4])]
            kind = sum(words[i] for i in which) // LINE * 2 + (2 * sum(linked[i] for i in which) > sum(chars[i] for i in which))
            text = "\n".join(t for i in which for t in own[i])
            out.append((key, xxhash.xxh64_intdigest(" ".join(shape)) >> 1, kind, xxhash.xxh64_intdigest(text) >> 1))
        return out

    def reads(self) -> int:
        """Hash of the text and its nodes: only copies share it, whatever their menus and adverts say.

        Branches that a strong name sets aside don't count, unless they hold an article or most of the page: then names are no guide, and all text counts.
        """
        aside = [False] * len(self.nodes)
        for i, (_, parent, off, _, _) in enumerate(self.nodes):
            aside[i] = aside[parent] or off in (OFF, NEVER)
        every = [(f"{self.nodes[node][0]} {_plain(raw)}", aside[node] and not self.nodes[node][3]) for block in self.blocks for raw, node, _ in block]
        rest = [text for text, off in every if not off]
        if 2 * sum(map(len, rest)) < sum(len(text) for text, _ in every):
            rest = [text for text, _ in every]
        return xxhash.xxh64_intdigest("\n".join(rest)) >> 1

    def text(self, verdicts: dict[int, int]) -> str:
        """The blocks of the branches that stay, given the host's verdicts by node."""
        size = len(self.nodes)
        says = [verdicts.get(node[0], 0) for node in self.nodes]
        gone = [False] * size
        for i, (_, parent, off, _, _) in enumerate(self.nodes):
            gone[i] = i > 0 and gone[parent] or off == NEVER or (off == OFF and not says[i] & STAYS_OFF) or (off == WEAK and bool(says[i] & GOES_WEAK))
        marked = any(self.nodes[node][3] and not gone[node] for block in self.blocks for _, node, _ in block)
        holds = [False] * size  # an article is in it
        for i in range(size - 1, 0, -1):
            holds[self.nodes[i][1]] = holds[self.nodes[i][1]] or holds[i] or self.nodes[i][3]
        bare = [False] * size  # its own text goes, what is below it is judged
        for i, (_, parent, off, inside, _) in enumerate(self.nodes):
            if i and gone[parent]:
                gone[i] = True
            elif gone[i] or off == OFF:
                continue
            elif inside:
                gone[i] = self.nodes[parent][3] and bool(says[i] & GOES_INSIDE)
            elif off == WEAK:
                bare[i] = bare[parent]  # inline: as the text around it
            elif marked:
                bare[i] = holds[i]
                gone[i] = not holds[i] and not says[i] & STAYS_OUTSIDE
            else:
                gone[i] = i > 0 and bool(says[i] & GOES)
        kept = (_plain("".join(raw for raw, node, _ in block if not gone[node] and not bare[node])) for block in self.blocks)
        return "\n".join(text for text in kept if text)


def _entropies(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pages, e0, e1, e2, l): pages of a node, entropy of its shape, kind and text over them, and number of shapes, from counts(by..., aspect, code, n)."""
    of = counts.groupBy(*by, "aspect").agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))).otherwise(0.0)
    aspect = lambda k, x: F.max(F.when(F.col("aspect") == k, x))
    return of.withColumn("e", entropy).groupBy(*by).agg(F.max("m").alias("pages"), *(aspect(k, F.col("e")).alias(f"e{k}") for k in range(3)), aspect(0, F.col("l")).alias("l"))


def _importance() -> Column:
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    return (1 - weight) * F.col("e0") + weight * (0.8 * F.col("e1") + 0.2 * F.col("e2"))


def style_tree(pages: DataFrame, *, names: bool = True, marks: bool = True) -> DataFrame:
    """(host, node, pages, importance, novelty, weight) of every node of each host's tree, the tree of all hosts mixed in.

    `novelty` is the entropy of the text alone, `weight` how many pages the evidence is worth.  A page that reads like another of its host counts once.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int64()), ("shape", pa.int64()), ("kind", pa.int64()), ("text", pa.int64())]))
        for batch in batches:
            found: dict[tuple, list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "", names=names, marks=marks)
                name = host, page.reads()
                if name not in found:
                    found[name] = [dict(zip(("node", "shape", "kind", "text"), x, strict=True)) for x in page.style()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), kind)], ["host", "page", "codes"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(codes, "host string, page long, codes array<struct<node: long, shape: long, kind: long, text: long>>")
    distinct = rows.groupBy("host", "page").agg(F.first("codes").alias("codes")).select("host", F.inline("codes"))
    aspects = distinct.select("host", "node", F.posexplode(F.array("shape", "kind", "text")).alias("aspect", "code"))
    seen = checkpointed(aspects.groupBy("host", "node", "aspect", "code").agg(F.count("*").alias("n")))  # read for the hosts and for all of them
    own = _entropies(seen, ["host", "node"]).select("host", "node", "pages", _importance().alias("i"), F.col("e2").alias("t"))
    pooled = _entropies(seen.groupBy("node", "aspect", "code").agg(F.sum("n").alias("n")), ["node"]).select("node", F.col("pages").alias("m"), _importance().alias("i2"), F.col("e2").alias("t2"))
    both = own.join(pooled, "node").withColumn("w", F.col("pages") - 1.0).withColumn("w2", POOL * (1 - 1 / F.col("m")))
    weight = F.col("w") + F.col("w2")
    mixed = lambda a, b: F.when(weight > 0, (F.col("w") * a + F.col("w2") * b) / weight).otherwise(0.0)
    return both.select("host", "node", "pages", mixed(F.col("i"), F.col("i2")).alias("importance"), mixed(F.col("t"), F.col("t2")).alias("novelty"), weight.alias("weight"))


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, says): for each host the nodes and verdict bits (see STAYS_OFF and the others) of nodes on a share of SUPPORT of its pages."""
    whole = tree.where("node = 0").select("host", F.col("pages").alias("all_pages"), ((F.col("weight") * F.col("importance") + PRIOR * EXPECTED) / (F.col("weight") + PRIOR)).alias("best"))
    given = lambda expected: (F.col("weight") * F.col("importance") + PRIOR * expected) / (F.col("weight") + PRIOR)
    novelty = (F.col("weight") * F.col("novelty") + PRIOR) / (F.col("weight") + PRIOR)
    bit = lambda k, condition: F.when(condition, k).otherwise(0)
    says = (
        bit(STAYS_OFF, given(EXPECTED_OFF) > F.col("best") * 0.85)
        + bit(STAYS_OUTSIDE, given(EXPECTED_OUTSIDE) >= F.col("best") / 2)
        + bit(GOES, given(EXPECTED) < F.col("best") / 2)
        + bit(GOES_INSIDE, novelty < 0.25)
        + bit(GOES_WEAK, novelty < 0.5)
    )
    judged = tree.where("node <> 0").join(whole, "host").where(F.col("pages") >= F.col("all_pages") * SUPPORT).select("host", "node", says.alias("says")).where("says > 0")
    return judged.groupBy("host").agg(F.collect_list(F.struct("node", "says")).alias("says"))


def extract_text(pages: DataFrame, *, names: bool = True, marks: bool = True, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty html give an empty text; a page cut off in a tag or comment keeps what comes before it; a very long page is parsed whole, by one
    task; repeated rows give repeated results; pages without a host share the tree of the empty host; an empty table gives no rows.  Extra columns are ignored.
    `names` and `marks` false let the tree decide without the pages' own names and article marks.
    """
    found = checkpointed(verdicts(style_tree(pages, names=names, marks=marks)))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    size = found.agg(F.coalesce(F.sum(F.size("says") + 1), F.lit(0))).first()[0]
    if size <= broadcast_rows:  # the bound is checked
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, texts = batch.slice(k, 256), []
                hosts, says = part.column(3).to_pylist(), part.column(4)
                for i, source in enumerate(part.column(2).to_pylist()):
                    if hosts[i] not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[hosts[i]] = {x["node"]: x["says"] for x in says[i].as_py() or ()}
                    texts.append(Page(source or "", names=names, marks=marks).text(known[hosts[i]]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "says").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
