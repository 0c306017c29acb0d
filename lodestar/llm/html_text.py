"""Main text of web pages by wrapper induction.

Pages become trees of their block elements; runs of like siblings that hold only text (paragraphs, list items) are one
node. A host's template is the alignment of all its pages' trees by simple tree matching: tasks fold their pages into a
template for each host, templates of a host are merged in two steps, and a text slot that had the same text on all its
pages, three different ones at least, is template. What a page holds in such slots goes, as does what its markup declares
to be no content (fixed values below); where a page declares its article, only that is content.

Defined results: null html or a page without text gives an empty text; pages with a null url or without a host are read by
their markup alone; repeated rows count once as pages of their host; malformed markup is read as HTML reads it, and blocks
nested deeper than DEPTH keep their text, in order, as blocks of that depth; an empty table gives an empty result; columns other
than page_id, url and html are passed over.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm import store

# Elements by their part in HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas audio video dialog menu".split())
ENDS_P = set("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ALSO = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_CONTENT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?|disqus|footer|gdpr|login|masthead|menu|modal|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
MIN_PAGES = 3
DEPTH = 200  # of blocks; what is nested deeper stands side by side there, so that trees can be gone through by recursion


class Node:
    __slots__ = ("label", "kids", "text", "content", "article")

    def __init__(self, label: str, content: bool = True, article: bool = False) -> None:
        self.label, self.kids, self.text, self.content, self.article = label, [], [], content, article


class Builder(HTMLParser):
    """Builds the tree; text of inline elements goes to the block around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open: list[tuple[str, Node, Node | None]] = []  # (tag, block, the block at the depth limit if it is deeper)
        self.places: dict[str, list[int]] = {}  # of each tag in self.open
        self.blocks: list[int] = []  # places in self.open that are not inline
        self.depth = 0
        self.deep_block: Node | None = None  # whose text the last flattened node holds
        self.articles = False
        self.push("", self.root, None)

    def push(self, tag: str, node: Node, home: Node | None) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, node, home))

    def cut(self, at: int) -> None:
        """Closes the elements from this place on."""
        while len(self.open) > at:
            tag, node, _ = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if node is not self.open[-1][1]:
                self.depth -= 1
                self.deep_block = None

    def place(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i) + 1 or -1  # a comment, in HTML

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.shut({"p"}, {"td", "th", "li", "button", "table"})
        if tag in ENDS_ALSO:
            self.shut(ENDS_ALSO[tag], {"ul", "ol", "dl", "table", "select"})
        _, around, home = self.open[-1]
        attr = dict(attrs)
        said = f"{attr.get('class') or ''} {attr.get('id') or ''}"
        off = tag in OUTSIDE or (tag == "header" and not around.article) or (attr.get("role") or "").lower() in ROLES or "hidden" in attr or (tag not in ("html", "body") and bool(NOT_CONTENT.search(said) or not around.article and HEADER.search(said)))
        if tag in INLINE and not off:
            self.push(tag, around, home)
            return
        main = tag in ("article", "main") or (attr.get("role") or "").lower() in ("main", "article")
        node = Node(f"{tag}.{re.sub(r'[0-9]+', '', said).strip()}", around.content and not off, around.article or (main and around.content and not off))
        self.articles |= node.article
        if self.depth >= DEPTH:
            home = home or around
        else:
            around.kids.append(node)
        self.depth += 1
        self.deep_block = None
        self.push(tag, node, home)

    def shut(self, tags: set[str], walls: set[str]) -> None:
        at = self.place(tags)
        if at > self.place(walls):
            self.cut(at)

    def handle_endtag(self, tag: str) -> None:
        at = self.place((tag,))
        if at > 0 and not (tag in INLINE and self.blocks[-1] > at):
            self.cut(at)

    def handle_data(self, data: str) -> None:
        _, node, home = self.open[-1]
        if home is None:
            if not (node.kids and node.kids[-1].label == "#"):
                node.kids.append(Node("#", node.content, node.article))
            node.kids[-1].text.append(data)
            return
        if self.deep_block is not node:
            flat = Node("deep", node.content, node.article)
            flat.kids.append(Node("#", node.content, node.article))
            home.kids.append(flat)
            self.deep_block = node
        home.kids[-1].kids[0].text.append(data)


def parse(html: str | None) -> Builder:
    b = Builder()
    # numbers of character references without leading zeros, and none that is far beyond all characters: long ones cannot be read
    b.feed(re.sub(r"&#[0-9]{8,}", "&#1114112", re.sub(r"&#0+(?=[0-9])", "&#", html or "")))
    HTMLParser.close(b)
    return b


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


# A shape is [label, kids, value, pages, blocks]: kids of inner nodes, of leaves the digest of the text ("" where it
# varies) and some digests of pages that had it; blocks are a page's own text nodes, None in a template.


def shape(node: Node, page: str) -> list | None:
    if node.label == "#":
        text = " ".join("".join(node.text).split())
        node.text = [text]
        return ["#", [], digest(text), [page], [node]] if text else None
    kids: list[list] = []
    for kid in node.kids:
        s = shape(kid, page)
        if s is None:
            continue
        if len(s[1]) == 1 and s[1][0][0] == "#":
            s = [f"{s[0]}*", [], s[1][0][2], [page], s[1][0][4]]
            if kids and kids[-1][0] == s[0]:
                kids[-1][4].extend(s[4])
                continue
        kids.append(s)
    for s in kids:
        if s[4] and len(s[4]) > 1:
            s[2] = digest("\n".join(n.text[0] for n in s[4]))
    return [node.label, kids, "", [], None] if kids else None


def page_shape(html: str | None) -> tuple[list | None, Builder]:
    b = parse(html)
    return shape(b.root, digest(html or "")), b


def match(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes that can be paired with order and depth kept, and the pairs of kids that do it."""
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a[1], b[1]
    rows = [[0] * (len(y) + 1)]
    won: dict[tuple[int, int], int] = {}
    for i, p in enumerate(x):
        last, row = rows[-1], [0]
        for j, q in enumerate(y):
            best = max(last[j + 1], row[j])
            if p[0] == q[0]:
                w = 1 + match(p, q, memo)[0] if p[1] and q[1] else 2 if p[2] == q[2] else 1
                won[i, j] = w
                best = max(best, last[j] + w)
            row.append(best)
        rows.append(row)
    i, j, pairs = len(x), len(y), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    memo[key] = rows[-1][-1], pairs[::-1]
    return memo[key]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """The template of both: paired leaves keep a text that they share, what only one has is taken over in its place."""
    memo = {} if memo is None else memo
    if not a[1] and not b[1]:
        return [a[0], [], a[2] if a[2] == b[2] else "", sorted({*a[3], *b[3]})[:MIN_PAGES], None]
    kids, j = [], 0
    partner = dict(match(a, b, memo)[1])
    for i, p in enumerate(a[1]):
        if i in partner:
            kids += [bare(q) for q in b[1][j : partner[i]]]
            kids.append(merge(p, b[1][partner[i]], memo))
            j = partner[i] + 1
        else:
            kids.append(p)
    return [a[0], kids + [bare(q) for q in b[1][j:]], "", [], None]


def bare(s: list) -> list:
    return [s[0], [bare(k) for k in s[1]], s[2], s[3], None]


def fixed_blocks(template: list, page: list, memo: dict, out: set[int]) -> None:
    """Adds the ids of the page's text nodes that stand in the template's constant slots."""
    for i, j in match(template, page, memo)[1]:
        p, q = template[1][i], page[1][j]
        if p[1] and q[1]:
            fixed_blocks(p, q, memo, out)
        elif q[4] and p[2] and p[2] == q[2] and len(p[3]) >= MIN_PAGES:
            out.update(map(id, q[4]))


def main_text(html: str | None, template: list | None) -> str:
    tree, b = page_shape(html)
    if tree is None:
        return ""
    fixed: set[int] = set()
    if template:
        fixed_blocks(template, tree, {}, fixed)
    out: list[str] = []

    def walk(node: Node) -> None:
        if node.label == "#":
            if node.content and (node.article or not b.articles) and id(node) not in fixed and node.text[0]:
                out.append(node.text[0])
        for kid in node.kids:
            walk(kid)

    walk(b.root)
    return "\n".join(out)


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


HELD = 500  # templates of a task before it hands them on


def fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (host, html): (host, salt, template) of the task's pages."""
    salt, held = TaskContext.get().partitionId() % 64, {}

    def flush() -> pa.RecordBatch:
        rows = [(h, salt, json.dumps(t)) for h, t in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["host", "salt", "template"])

    for batch in batches:
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tree, _ = page_shape(html.as_py())
            if tree:
                held[name] = merge(held[name], tree) if name in held else bare(tree)
            if len(held) > HELD:
                yield flush()
    if held:
        yield flush()


def merge_group(key: tuple, batches: pa.Table) -> pa.Table:
    """For applyInArrow: the template of all templates of a group."""
    out = None
    for t in batches.column("template"):
        t = json.loads(t.as_py())
        out = merge(out, t) if out else t
    return pa.table({"host": [key[0].as_py()], "salt": pa.array([0], pa.int32()), "template": [json.dumps(out)]})


def constant_part(template: list) -> list | None:
    """A template without what cannot matter: None if it has no constant slot."""
    def any_fixed(t: list) -> bool:
        return any(map(any_fixed, t[1])) if t[1] else bool(t[2]) and len(t[3]) >= MIN_PAGES

    return template if any_fixed(template) else None


def templates(pages: DataFrame) -> DataFrame:
    """pages: url, html. (host, template)."""
    schema = "host string, salt int, template string"
    folded = pages.select(host(F.col("url")).alias("host"), "html").where("host IS NOT NULL").mapInArrow(fold_pages, schema)
    merged = folded.groupBy("host", "salt").applyInArrow(merge_group, schema).groupBy("host").applyInArrow(merge_group, schema)
    return merged.select("host", "template")


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (page_id, url, html, template): page_id, url, text, n_chars."""
    known: dict[str, list | None] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            texts = []
            for html, template in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                if template and template not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[template] = constant_part(json.loads(template))
                texts.append(main_text(html.as_py(), known[template] if template else None))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. page_id, url, text, n_chars of each row."""
    wrappers = store.table(templates(pages), "wrappers").withColumnRenamed("host", "_host")
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("_host"))
    return told.join(wrappers, "_host", "left").select("page_id", "url", "html", "template").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op4(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
