"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: elements with the same path of tags and classes are one
branch of the site's tree. Two kinds of evidence say how important a branch is:

- presentation: the entropy of the child sequences that the branch has on its pages. A menu looks
  the same everywhere, an article does not;
- content: one less the mean entropy of its texts over the pages. A text on one page only has entropy 0,
  one on every page has entropy 1.

The more children a branch has, the more presentation counts (``GAMMA``). Importance is mixed with what
tags, classes and roles say (``PRIOR``): main content, or nothing; beside main content that the page
names, that it is none (``BESIDE``). On a host of few pages, which show little, this counts more; from some six
pages on entropy can overrule it both ways. Branches of importance up to ``LEVEL`` are cut from each page.

Branches labelled as noise are cut, as advertisements and comments differ from page to page as much as
main content does. But the label is a wrapper's and does not count where it holds more than ``WHOLE`` of
the text that entropy does not call noise, if the page names no main content outside it. Within main content this
goes for all labels but those of comments and links (``VARIED``).

Text in what is left: character references decoded, white space inside a block turned into one
space, blocks in page order joined by a line feed. Inline elements and line breaks do not end a block.

Defined results: null html is an empty page with empty text; broken markup (open or stray tags,
comments without end) is read as browsers do, as far as blocks go; a page whose whole content would be
cut keeps what entropy does not call noise, without labelled noise if that leaves anything, and if there is
nothing of it, what no label calls noise; pages of a null ``url`` form one site. Repeated rows have a result
each. An empty table gives an empty result. Only ``page_id``, ``url`` and ``html`` are looked at.
"""

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import row_key
from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import spread_join

GAMMA, PRIOR, LEVEL, BESIDE, WHOLE = 0.9, 0.4, 0.5, 0.25, 0.5
# So many branches of all hosts are broadcast at most; beyond that, each page is joined with its own.
BROADCAST_BRANCHES = 200_000

# How HTML names its elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "svg", "math", "object", "canvas", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSED_BY_BLOCK = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
CLOSED_BY_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"ul", "ol", "menu", "dl", "table", "article", "section", "div", "main", "body"}
# What tags, roles and words in classes and ids say about a branch.
NOISE_TAGS = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "search"}
NOISE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
NOISE_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promoted",
    "promotion", "reader", "readers", "related", "replies", "reply", "respond", "responses", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
VARIED = {
    "comment", "comments", "commentlist", "discussion", "disqus", "reader", "readers", "related", "replies", "reply",
    "respond", "responses",
}
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = {"articlebody", "entry-content", "article-body", "article-content", "post-content", "post-body", "story-body", "main-content"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]{0,10000}\"|'[^']{0,10000}')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>",
    re.S | re.I,
)
TELLING = re.compile(r"\b(?:class|id|role|hidden|itemprop)\b", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")


class Branch:
    """An element of a page: its path hash, what its label says, and its children."""

    __slots__ = ("tag", "path", "label", "varied", "inside", "children", "up")

    def __init__(self, tag: str, path: int, label: int, up: "Branch | None", varied: bool = False) -> None:
        self.tag, self.path, self.label, self.up, self.varied = tag, path, label, up, varied
        self.children: list[str] = []
        self.inside = label == 1 or (up is not None and up.inside)


@lru_cache(10_000)
def label_of(tag: str, attributes: str, inside: bool) -> tuple[str, int, bool]:
    """The branch name, -1 for noise, 1 for main content, 0 for neither, and whether it is noise that varies."""
    names, role, label = "", "", 0
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            name = name.lower()
            if name == "role":
                role = value
            elif name == "hidden":
                label = -1
            elif name == "itemprop":
                names += " " + value
            elif name == "class":
                names += " " + value
            else:
                names += " #" + value
    words = set(names.split())
    parts = set(WORD.findall(names))
    if tag in NOISE_TAGS or role in NOISE_ROLES or parts & NOISE_WORDS or (tag == "header" and not inside):
        label = -1
    elif label == 0 and (tag in MAIN_TAGS or role in ("main", "article") or words & MAIN_WORDS):
        label = 1
    return tag + (" " + " ".join(sorted(w for w in words if not w.startswith("#"))) if words else ""), label, label < 0 and bool(parts & VARIED)


def parse(page: str | None) -> tuple[list[tuple[Branch, str]], list[Branch]]:
    """The blocks of a page, each with the branch it stands in, and all its branches.

    Inline elements without a label are no branches: their text is part of the block around them.
    """
    root = Branch("", 0, 0, None)
    stack, blocks, branches, parts = [root], [], [], []
    labelled: set[str] = set()

    def flush() -> None:
        joined = "".join(parts)
        parts.clear()
        if "&" in joined:
            joined = entities.unescape(joined)
        joined = " ".join(joined.split())
        if joined:
            blocks.append((stack[-1], joined))

    def leave(tags: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in HOLDS:
                return

    found = iter(TOKEN.split(page or ""))
    for text in found:
        if text:
            parts.append(text)
        raw, slash, tag, attributes = next(found, None), next(found, None), next(found, None), next(found, None)
        slash_2, tag_2, attributes_2 = next(found, None), next(found, None), next(found, None)
        tag = tag or tag_2
        if tag is None:
            if raw:
                parts.append(" ")
            continue
        tag, attributes = tag.lower(), attributes or attributes_2
        if slash or slash_2:
            if tag in BLOCK or tag in labelled:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        flush()
                        del stack[k:]
                        break
            continue
        block = tag in BLOCK
        telling = bool(attributes) and TELLING.search(attributes) is not None
        if not block and not telling:
            if tag in VOID:
                parts.append(" ")
            continue
        if block:
            flush()
            if tag == "hr":
                continue
            leave(CLOSED_BY_BLOCK)
            if tag in CLOSED_BY_SELF:
                leave(CLOSED_BY_SELF[tag])
        up = stack[-1]
        name, label, varied = label_of(tag, attributes if telling else "", up.inside)
        if not block:
            if not label or tag in VOID:
                parts.append(" " if tag in VOID else "")
                continue
            flush()
            labelled.add(tag)
        up.children.append(name)
        branch = Branch(tag, zlib.crc32(name.encode(), up.path) | (len(name) << 32), label, up, varied)
        branches.append(branch)
        stack.append(branch)
    flush()
    return blocks, branches


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


def _chain(branch: Branch) -> list[Branch]:
    """The branch and those above it that may be cut, the highest first."""
    out = []
    while branch.up is not None:
        if branch.tag not in ("html", "body"):
            out.append(branch)
        branch = branch.up
    return out[::-1]


def observe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, path, kind, h, size``: child sequences (kind 0) and texts (kind 1) of each branch of each page."""
    for part in parts:
        rows: set[tuple] = set()
        out: list[tuple] = []
        for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            rows.clear()
            blocks, branches = parse(page)
            for b in branches:
                if b.tag not in ("html", "body"):
                    rows.add((host, b.path, 0, _hash("\n".join(b.children)), len(b.children)))
            for owner, text in blocks:
                h = _hash(text)
                for b in _chain(owner):
                    rows.add((host, b.path, 1, h, 0))
            out.extend(rows)
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    host, path, kind, h, size = zip(*out, strict=True)
    return pa.record_batch(
        [pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(size, pa.int64())],
        names=["host", "path", "kind", "h", "size"],
    )


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, importance, looks``: by entropy alone, of every branch that has evidence."""
    seen = _with_host(pages).mapInArrow(observe, "host string, path bigint, kind int, h bigint, size bigint")
    counts = seen.groupBy("host", "path", "kind", "h").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    c, look, text = F.col("c").cast("double"), F.col("kind") == 0, F.col("kind") == 1
    branches = counts.groupBy("host", "path").agg(
        F.sum(F.when(look, c).otherwise(0.0)).alias("looks"),
        F.sum(F.when(look, c * F.log(c)).otherwise(0.0)).alias("look_sum"),
        F.sum(F.when(look, c * F.col("size")).otherwise(0.0)).alias("children"),
        F.sum(F.when(text, F.log(c)).otherwise(0.0)).alias("text_sum"),
        F.count(F.when(text, 1)).alias("texts"),
    ).filter("looks > 1")
    m = F.col("looks")
    look_importance = (F.log(m) - F.col("look_sum") / m) / F.log(m)
    text_importance = F.when(F.col("texts") > 0, 1 - F.col("text_sum") / F.col("texts") / F.log(m)).otherwise(0.0)
    weight = F.pow(F.lit(GAMMA), F.col("children") / m)
    importance = F.least(F.greatest((1 - weight) * look_importance + weight * text_importance, F.lit(0.0)), F.lit(1.0))
    return branches.select("host", "path", importance.alias("importance"), "looks")


def main_blocks(page: str | None, evidence: dict[int, tuple[float, float]]) -> list[str]:
    """The blocks of a page that stay, by the importance and the number of looks of each path."""
    blocks, branches = parse(page)
    has_main = any(owner.inside and all(b.label >= 0 for b in _chain(owner)) for owner, _ in blocks)
    # what holds main content is not cut as a whole
    holds: dict[int, bool] = {}
    for b in branches:
        if b.inside:
            up = b.up
            while up is not None and id(up) not in holds:
                holds[id(up)] = True
                up = up.up
    high = [all(evidence.get(b.path, (1.0, 1.0))[0] > LEVEL for b in _chain(owner)) for owner, _ in blocks]
    shares: dict[int, int] = {}
    for (owner, text), content in zip(blocks, high, strict=True):
        for b in _chain(owner) if content else ():
            shares[id(b)] = shares.get(id(b), 0) + len(text)
    whole = WHOLE * sum(len(text) for (_, text), content in zip(blocks, high, strict=True) if content)
    for b in branches:
        if b.label < 0 and shares.get(id(b), 0) > whole and (not has_main or (b.inside and not b.varied)):
            b.label = 0
    has_main = any(owner.inside and all(b.label >= 0 for b in _chain(owner)) for owner, _ in blocks)
    cut: dict[int, bool] = {}

    def gone(branch: Branch) -> bool:
        if branch.up is None or branch.tag in ("html", "body"):
            return False
        key = id(branch)
        if key not in cut:
            if gone(branch.up):
                cut[key] = True
            else:
                if branch.inside or key in holds:
                    prior = 1.0
                else:
                    prior = BESIDE if has_main else 0.5
                importance, looks = evidence.get(branch.path, (0.0, 1.0))
                said = (1 - PRIOR) * (1 - 1 / looks)
                mixed = (1 - said) * prior + said * importance
                cut[key] = branch.label < 0 or (mixed <= LEVEL if said else prior < LEVEL)
        return cut[key]

    kept = [text for owner, text in blocks if not gone(owner)]
    if kept or not blocks:
        return kept
    plain = {k for k, (owner, _) in enumerate(blocks) if all(b.label >= 0 for b in _chain(owner))}
    content = {k for k, c in enumerate(high) if c}
    return [blocks[k][1] for k in sorted(plain & content or content or plain)]


def _paths(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, row, path``: the different branches of each page."""
    for part in parts:
        hosts, rows, paths = [], [], []
        for host, row, page in zip(*(part.column(c).to_pylist() for c in ("host", "row", "html")), strict=True):
            own = {b.path for b in parse(page)[1]}
            hosts += [host] * len(own)
            rows += [row] * len(own)
            paths += own
            if len(paths) > 50_000:
                yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(rows, pa.string()), pa.array(paths, pa.int64())], names=["host", "row", "path"])
                hosts, rows, paths = [], [], []
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(rows, pa.string()), pa.array(paths, pa.int64())], names=["host", "row", "path"])


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        pages, owners, marks = part.column("html").to_pylist(), part.column("owner").to_pylist(), part.column("marks")
        texts, known, last = [], {}, None
        for k, page in enumerate(pages):
            mark = marks[k]
            if mark.is_valid:
                if owners[k] != last:
                    last = owners[k]
                    known = {x["path"]: (x["importance"], x["looks"]) for x in mark.as_py()}
            else:
                last, known = None, {}
            texts.append("\n".join(main_blocks(page, known)))
        yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main(pages: DataFrame, broadcast_branches: int = BROADCAST_BRANCHES) -> DataFrame:
    """``page_id, url, text`` for every page."""
    tree = keep(style_tree(pages))
    here = _with_host(pages)
    mark = F.struct("path", "importance", "looks")
    if stored_rows(tree) <= broadcast_branches:
        marks = keep(tree.groupBy("host").agg(F.collect_list(mark).alias("marks")))
        marked = here.join(F.broadcast(marks), "host", "left").withColumn("owner", F.col("host"))
    else:
        here = here.withColumn("row", row_key("page_id", "html"))
        paths = here.select("host", "row", "html").mapInArrow(_paths, "host string, row string, path bigint")
        sizes = tree.select("host", "path", F.col("looks").cast("bigint").alias("rows"))
        found = spread_join(paths, tree, ["host", "path"], by="row", sizes=sizes)
        # repeated pages have one key, so a set holds no more than the branches of one page
        marks = keep(found.groupBy("host", "row").agg(F.collect_set(mark).alias("marks")))
        marked = here.join(marks, ["host", "row"], "left").withColumn("owner", F.concat("host", F.lit("/"), "row"))
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string"
    return marked.select("page_id", "url", "html", "owner", "marks").mapInArrow(_extract, schema)
