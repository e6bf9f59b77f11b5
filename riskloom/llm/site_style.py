"""Operator 9: main text of web pages by a site style tree.

Pages of a host are merged by the styles of their elements: a node is a path of tags and
classes.  A node is important if its content differs from page to page (one minus the mean
entropy of its blocks over the pages that have them) and if pages vary how they present it
(the entropy of the styles of its children), blended by the number of those styles.  Hosts
with few pages lean on the tree of all hosts (``PRIOR_PAGES``).  Elements that their tag,
class, id or role as a whole names as menu, header, footer, sidebar, notice, advert, form or
comments are of no importance, a part of a name halves it; names of html, body and of what
holds all articles, forms around a page, and ids of headings and sections say nothing.  What
stands in an ``article`` or ``main`` element is kept unless so named; any other branch has
to reach ``KEEP``, or twice that on pages that have an article.

Text is decoded, white space inside a block becomes one blank, blocks are joined by line
feeds in page order.  Whole pages are read and nothing kept is shortened.  Null or empty
html gives an empty text, a null url an empty host; repeated rows and null ids each give a
row.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

KEEP = 0.4
PRIOR_PAGES = 20
GAMMA = 0.9

# Names of elements and of classes, ids or roles.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
UNSEEN = "script|style|title|textarea|noscript|template|svg|math|iframe"
ARTICLE = {"article", "main"}
ASIDE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "label", "select", "button"}
ASIDE_NAMES = set(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer form header masthead menu menubar nav navbar navigation navigation-bar newsletter notice notices notification popup promo "
    "promotion related responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>|<(?P<raw>{UNSEEN})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.S | re.I)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+")
NO_IDS = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}  # their ids are free text
HOLDERS = ARTICLE | {"h1", "nav", "header", "footer"}


@dataclass
class Element:
    tag: str
    style: str  # tag and classes
    path: str  # styles from the root, inline elements left out
    parent: Element | None
    out: bool  # by its tag or as hidden no part of the article
    named: bool  # the same by a whole name
    hint: bool  # part of a name says so: lowers the importance
    landmark: bool
    article: bool  # a landmark or inside one
    aside: bool = False  # all in all no part of the article, or inside such
    faint: bool = False  # hinted at, or inside such
    form: Element | None = None  # the outermost around it
    holds: bool = False  # an article
    wraps: bool = False  # parts of a page
    children: list[str] = field(default_factory=list)


def _element(tag: str, attrs: str, parent: Element) -> Element:
    classes, out, named, hint, landmark = [], False, False, False, tag in ARTICLE
    root = tag in ("html", "body")
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values).lower(), name.lower()
            if name == "class":
                classes = sorted(value.split())
            if name in ("class", "role") or name == "id" and tag not in NO_IDS:
                for w in () if root else value.split():
                    parts = set(_NAME.findall(w))
                    named |= w in ASIDE_NAMES or bool(parts) and parts <= ASIDE_NAMES
                    hint |= bool(ASIDE_NAMES & parts)
                landmark |= name == "role" and value in ARTICLE
            out |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    out |= tag in ASIDE_TAGS and tag != "form" and not (tag == "header" and parent.article)
    style = ".".join([tag, *classes])
    path = parent.path if tag in INLINE else f"{parent.path}>{style}"
    return Element(tag, style, path, parent, out and not root, named, hint, landmark, landmark or parent.article)


def _resolve(elements: list[Element], blocks: list[tuple[Element, str]]) -> None:
    """Set aside and faint of all elements (parents come first).

    A form or hinted element that holds parts of a page, or a form with half its text, is none; if all articles would go,
    the names and forms around them do not count."""
    for e in elements:
        up = e
        while up and e.landmark and not up.holds:
            up.holds, up = True, up.parent
        up = e if e.landmark else e.parent
        while up and (e.landmark or e.tag in HOLDERS) and not up.wraps:
            up.wraps, up = True, up.parent
    sizes: dict[int, int] = {}
    for e, text in blocks:
        if e.form and not e.form.article:
            sizes[id(e.form)] = sizes.get(id(e.form), 0) + len(text)
    whole = sum(len(text) for _, text in blocks) if sizes else 0
    for e in elements:
        e.wraps |= e.form is e and 2 * sizes.get(id(e), 0) >= max(whole, 1)
    for spare in (False, True):
        for e in elements:
            mine = e.out or (e.named or e.tag == "form" and not e.wraps) and not (spare and e.holds)
            e.aside = mine or e.parent.aside
            e.faint = e.hint and not e.wraps or e.parent.faint
        if not all(e.aside for e in elements if e.landmark):
            break


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(blocks with their innermost block element, block elements) of a page, in order."""
    root = Element("", "", "", None, False, False, False, False, False)
    stack, blocks, seen, run, elements = [root], [], [], [], []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((stack[-1], text))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        tag = m["tag"]
        if not tag:  # a comment or what is never shown
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            over = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in over:
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag not in over:
                    break
        e = _element(tag, m["attrs"] or "", stack[-1])
        e.form = stack[-1].form or (e if tag == "form" else None)
        elements.append(e)
        if tag not in INLINE:
            stack[-1].children.append(e.style)
            seen.append(e)
        if not m["attrs"].endswith("/"):
            stack.append(e)
    if at < len(page):
        run.append(entities.unescape(page[at:]))
    flush()
    _resolve(elements, blocks)
    return blocks, seen


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def host(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, importance of each node outside articles and named asides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[str, str, bool, int], int] = {}
            for h, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks, seen = parse(page or "")
                rows = {(h, e.path, True, _hash(text)) for e, text in blocks}
                styles: dict[str, list[str]] = {}
                for e in seen:
                    styles.setdefault(e.path, []).extend(dict.fromkeys(e.children))
                rows |= {(h, p, False, _hash(" ".join(dict.fromkeys(c)))) for p, c in styles.items()}
                for r in rows:
                    out[r] = out.get(r, 0) + 1
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()),
                 pa.array(cols[3], pa.int64()), pa.array(list(out.values()), pa.int64())], ["host", "path", "content", "what", "k"])

    seen = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string, content boolean, what bigint, k bigint")
    counted = materialise(seen.groupBy("host", "path", "content", "what").agg(F.sum("k").alias("k")), "sst_counts")

    def importance(counts: DataFrame, keys: list[str]) -> DataFrame:
        style, k = ~F.col("content"), F.col("k")
        per = counts.groupBy(*keys).agg(
            F.sum(F.when(style, k)).alias("m"), F.count(F.when(style, 1)).alias("l"), F.sum(F.when(style, k * F.log(k))).alias("klogk"),
            F.avg(F.when(~style, F.log(k))).alias("logk"))
        m = F.coalesce("m", F.lit(1))
        shown = F.when(m > 1, F.log(m) - F.col("klogk") / m).otherwise(F.log(m)) / F.when(m > 1, F.log(m)).otherwise(1.0)
        shown = F.when(m > 1, shown).otherwise(1.0)
        told = F.when((m > 1) & F.col("logk").isNotNull(), 1 - F.least(F.col("logk") / F.log(m), F.lit(1.0))).otherwise(1.0)
        weight = F.pow(F.lit(GAMMA), F.coalesce("l", F.lit(0)))
        return per.select(*keys, m.alias("m"), ((1 - weight) * shown + weight * told).alias("i"))

    here = importance(counted, ["host", "path"])
    overall = importance(counted.groupBy("path", "content", "what").agg(F.sum("k").alias("k")), ["path"]).select("path", F.col("i").alias("all_i"))
    return here.join(overall, "path").select("host", "path", ((F.col("m") * F.col("i") + PRIOR_PAGES * F.col("all_i")) / (F.col("m") + PRIOR_PAGES)).alias("importance"))


def main_text(page: str, faint: set[str], weak: set[str]) -> str:
    blocks, _ = parse(page)
    has_article = any(e.article and not e.aside for e, _ in blocks)
    low = faint if has_article else weak
    return "\n".join(text for e, text in blocks if not e.aside and (e.path not in faint if e.faint else e.article or e.path not in low))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    pages = pages.select("page_id", "url", "html")
    i = F.col("importance")
    # Per host only its nodes of low importance: its templates' paths, not its pages.
    low = (style_tree(pages).where(i < 2 * KEEP).groupBy("host")
           .agg(F.collect_set("path").alias("faint"), F.collect_set(F.when(i < KEEP, F.col("path"))).alias("weak")))
    # Read back, so that the planner knows its size when it chooses the join.
    low = materialise(low, "sst_low")
    joined = pages.withColumn("host", host()).join(low, "host", "left").select("page_id", "url", "html", "faint", "weak")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(page or "", set(faint or ()), set(weak or ()))
                         for page, faint, weak in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string")
