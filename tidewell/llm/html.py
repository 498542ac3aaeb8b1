"""Main text of web pages: templates deduced per host from token equivalence classes, then slots extracted."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_names, table

# Element and attribute names of HTML, grouped by what they mean for the article.
_SKIPPED = set("nav footer aside form button select textarea input option iframe svg canvas object noscript template menu dialog head title header".split())
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul title""".split())
_CLOSES_P = _BLOCKS - {"br", "option", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "body", "html", "head", "title", "noscript"}
_ITEMS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_HEADINGS = set("h1 h2".split())
#: Elements that hold text rather than parts of a page.
_TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote b i em strong span a td th figcaption caption address center".split())
#: Words of ids and classes that tell what is not the article: as any part of a name, and as a whole name or its last part.
_ANYWHERE = re.compile(r"ads?|adv|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus\w*|footer|gdpr|modal|nav|navbar|newsletter|pagination|popup|promo\w*|related|shar(?:e|ing)|sidebar|social|sponsor\w*|subscri\w*|widgets?")
_LAST = re.compile(r"banner|copyright|dialog|disclaimer|discussion|header|hidden|masthead|menu\w*|navigation|notices?|notifications?|overlay|pager|popover|reactions?|recommend\w*|repl(?:y|ies)|respond|responses?|search\w*|signup|skip|teasers?|toolbar|trending")
#: Names that only switch something on or off, such as with-sidebar and header-fixed, say nothing on what an element holds.
_SWITCH = set("with without no not has have is show hide enable supports".split()), set("on off fixed sticky enabled disabled active open closed visible".split())
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>", re.S)
_PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>""")
_FULL = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_LANG = re.compile(r"""<html(?:\s[^>]*)?\slang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Times the page's length that may be spent on quoted values with a < in them whose tag then proves to be broken.
_PATIENCE = 16


@dataclass(slots=True)
class Block:
    text: str
    path: int  #: hash of the enclosing elements and their classes
    inside: bool  #: in an article or main element, or in the host's main slot
    skipped: bool  #: in a menu, header, footer, sidebar, notice, advert, form or comments
    linked: int  #: characters in links


@dataclass(slots=True)
class Node:
    """An element in its path, over all its occurrences on a page."""

    parent: int
    kind: int  #: 0 a part of the page, 1 textual, 2 a heading, 3 an article or main element
    count: int = 0
    chars: int = 0  #: characters of text in it
    linked: int = 0  #: those in links


@dataclass(slots=True)
class _Element:
    tag: str
    path: int
    inside: bool
    skipped: bool
    link: bool


def _attributes(given: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(given)}


def _named(names: str) -> bool:
    """Whether ids and classes tell of something that is not the article."""
    for name in re.split(r"\s+", names.lower()):
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if parts and not (len(parts) > 1 and (parts[0] in _SWITCH[0] or parts[-1] in _SWITCH[1])) and (any(_ANYWHERE.fullmatch(x) for x in parts) or _LAST.fullmatch(parts[-1])):
            return True
    return False


class _Tags:
    """The tags of a page, one after another, in time that grows with its length."""

    def __init__(self, html: str):
        self.html, self.last, self.patience = html, html.rfind(">"), _PATIENCE * len(html)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; the name is empty for comments and the like."""
        html = self.html
        while 0 <= (at := html.find("<", at)):
            if html.startswith("<!--", at) or at < self.last and html[at + 1 : at + 2] in ("!", "?") or at < self.last and html[at + 1 : at + 2] == "/" and not html[at + 2 : at + 3].isalpha():
                m = _COMMENT.match(html, at)
                return at, m.end(), "", "", ""
            if at > self.last:
                return None
            m = _PLAIN.match(html, at)
            if m is None and self.patience > 0 and (m := _FULL.match(html, at)) is None:
                self.patience -= len(html) - at
            m = m or _LOOSE.match(html, at)
            if m:
                return at, m.end(), m[1], m[2].lower(), m[3]
            at += 1
        return None


def parse(html: str, main: int | None = None) -> tuple[list[Block], dict[int, Node]]:
    """Text blocks in page order, and the elements by path.  `main` is the path of the host's main slot, if known.

    Works on malformed pages: paragraphs and items close where others start, stray end tags are
    ignored, an end tag closes what is open inside its element, and an article that starts in a
    menu, header, notice or advert whose end tag is missing is taken out of it.  Takes time in
    proportion to the length: open elements are found by their tag, not by walking the stack.
    """
    stack = [_Element("", 0, False, False, False)]
    open_at: dict[str, list[int]] = defaultdict(list)
    walls: list[int] = []  # places of open block elements other than p
    blocks: list[Block] = []
    nodes: dict[int, Node] = {}
    own: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    parts: list[str] = []
    linked = 0
    low = None
    torn: dict[str, bool] = {}  # elements whose end tags are missing on this page

    def end_block() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                top = stack[-1]
                blocks.append(Block(text, top.path, top.inside, top.skipped, linked))
                own[top.path][0] += len(text)
                own[top.path][1] += min(linked, len(text))
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        while len(stack) > i:
            e = stack.pop()
            open_at[e.tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()

    latest = lambda tags: max((open_at[t][-1] for t in tags if open_at[t]), default=0)
    at, n, tags = 0, len(html), _Tags(html)
    while at < n:
        m = tags.next(at)
        to = m[0] if m else n
        if to > at:
            parts.append(html[at:to])
            if stack[-1].link:
                linked += to - at
        if m is None:
            break
        _, at, end, tag, given = m
        if not tag:
            continue
        if tag in _BLOCKS:
            end_block()
        if end:
            if open_at[tag]:
                i = open_at[tag][-1]
                if parts and (latest(("p",)) > i or walls and walls[-1] > i):
                    end_block()
                close(i)
            continue
        if tag in _ITEMS:
            until = latest(_ITEMS[tag])
            like = latest({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag})
            if like > until:
                close(like)
        elif tag in _CLOSES_P and open_at["p"] and open_at["p"][-1] > (walls[-1] if walls else 0):
            close(open_at["p"][-1])
        if tag in ("article", "main") and stack[-1].skipped:
            low = low or html.lower()
            first = next(i for i, e in enumerate(stack) if e.skipped) if len(stack) < 1000 else 0
            broken = stack[first].tag
            if broken not in torn:
                torn[broken] = bool(broken) and low.count(f"<{broken}") > low.count(f"</{broken}")
            if torn[broken]:
                close(first)
        top = stack[-1]
        named, skipped = "", top.skipped
        if given and tag not in ("a", "img", "br", "span", "b", "i", "em", "strong", "html", "body"):
            attributes = _attributes(given)
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
            skipped = skipped or hidden or attributes.get("role", "").lower() in _ROLES or tag != "main" and _named(f"{attributes.get('id', '')} {attributes.get('class', '')}")
            named = attributes.get("class", "")
        if tag in _SKIPPED and not (tag == "header" and top.inside):
            skipped = True
        path = signed(xxhash.xxh64_intdigest(f"{tag}.{named}", top.path & _ALL))
        here = path == main
        if path not in nodes:
            nodes[path] = Node(top.path, 3 if tag in ("article", "main") else 2 if tag in _HEADINGS else 1 if tag in _TEXTUAL else 0)
        nodes[path].count += 1
        if tag in _RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = shut.end() if shut else n
            at = html.find(">", at) + 1 or n
        elif tag not in _VOID and not given.endswith("/"):
            inside = top.inside or here or main is None and tag in ("article", "main") and not skipped
            open_at[tag].append(len(stack))
            if tag in _BLOCKS and tag != "p":
                walls.append(len(stack))
            stack.append(_Element(tag, path, inside, skipped and not here, top.link or tag == "a"))
    end_block()
    # a path comes after its parent's: text adds up from the last one on
    for path in reversed(nodes):
        node, (chars, links) = nodes[path], own.get(path, (0, 0))
        node.chars, node.linked = node.chars + chars, node.linked + links
        if node.parent in nodes:
            nodes[node.parent].chars += node.chars
            nodes[node.parent].linked += node.linked
    return blocks, nodes


_ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def text_token(block: Block) -> int:
    return signed(xxhash.xxh64_intdigest(block.text, block.path & _ALL))


def host(url: str | None) -> str:
    """Lower-cased host of a URL without port and user; empty if there is none."""
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def page_text(html: str, template: frozenset[int] | set[int], main: int | None = None) -> tuple[str, int, bool]:
    """Main text, the number of template blocks left out, and whether the host's main slot was found on the page.

    Slots are the blocks that are not template text of the host.  Those inside the main slot
    that the host's template has are the text.  On a page without it, those in its article or
    main element are; without such, all slots outside menus and the like, but for short ones that are mostly links.
    """
    mine: list[Block] = []
    if main is not None:
        blocks, _ = parse(html, main)
        mine = [b for b in blocks if b.inside and not b.skipped]
    slotted = bool(mine)
    if not mine:
        blocks, _ = parse(html)
        mine = [b for b in blocks if b.inside and not b.skipped] or [b for b in blocks if not b.skipped and not (2 * b.linked > len(b.text) and len(b.text) < 200)]
    slots = [b.text for b in mine if text_token(b) not in template]
    return " ".join(slots), len(mine) - len(slots), slotted


def nest(nodes: dict[int, tuple[int, int, object, int, int]]) -> dict[int, int]:
    """The template: each node of the valid classes that nest, and the node that it lies in (0: the page).

    `nodes` has (parent, kind, class, chars, linked) by path, parents included.  A class is the
    set of nodes that share an occurrence vector.  It nests if all its outermost nodes lie in
    one node of other classes that is in the template itself; the others are content.
    """
    classes: dict[object, list[int]] = defaultdict(list)
    for path, node in nodes.items():
        classes[node[2]].append(path)
    outer = {c: {nodes[x][0] for x in own if nodes[x][0] not in nodes or nodes[nodes[x][0]][2] != c} for c, own in classes.items()}
    template: dict[int, int] = {}
    waiting = {c for c, above in outer.items() if len(above) == 1}
    while ready := [c for c in waiting if (above := next(iter(outer[c]))) in template or above not in nodes]:
        for c in ready:
            waiting.discard(c)
            template |= {x: nodes[x][0] for x in classes[c]}
    return template


def main_slot(nodes: dict[int, tuple[int, int, object, int, int]], template: dict[int, int], most: float = 0.6) -> int | None:
    """The template's node that is the article, or None if no part of the page stands out.

    From the page down, the way goes to the part that holds at least `most` of the unlinked text
    on the host's pages.  It ends at an article or main element and where headings stand, as a title belongs to its text.
    """
    weight = lambda x: nodes[x][3] - nodes[x][4]
    below: dict[int, list[int]] = defaultdict(list)
    for x, parent in template.items():
        below[parent].append(x)
    heads = {nodes[x][0] for x in nodes if nodes[x][1] == 2}
    tops = [x for x in template if template[x] not in template]
    at, own = None, sum(map(weight, tops))
    while own > 0 and (parts := [x for x in (tops if at is None else below[at]) if nodes[x][1] in (0, 3)]):
        best = max(parts, key=lambda x: (weight(x), x))
        if weight(best) < most * own:
            break
        at, own = best, weight(best)
        if nodes[at][1] == 3 or at in heads:
            break
    return at


def templates(pages: DataFrame, share: float = 0.9, least: int = 3) -> DataFrame:
    """(host, n_pages, texts, main, classes) of hosts with at least `least` different pages; `pages` has url and html.

    Tokens are elements in their path and text blocks in their path.  Pages of a host
    with equal tokens are copies and count once, else all text of a page that is there often
    would be a template.  For each token of a host, the vector of its counts over the pages is
    represented by the number of pages and two sums of hashed (page, count) pairs, which
    combine on the map side: no page list is gathered, and a host with a third of all pages
    is no heavier.  Tokens of equal vectors form a class; it is valid if it covers at least
    `share` of the host's pages.  Valid classes are nested (`nest`), and of the slots between
    them the main one is taken (`main_slot`) by the text that the host's pages hold there.
    `texts` are the text tokens of valid classes with two tokens, on hosts of at least
    10 pages and outside the main slot or in markup classes.  What reaches one task is a host's valid markup, at most a page's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "key", "token", "n", "text", "parent", "kind", "chars", "linked"]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, nodes = parse(html or "")
                texts = Counter(text_token(b) for b in blocks if not b.skipped)
                every = [(0, 1, False, 0, 0, 0, 0), *((x, e.count, False, e.parent, e.kind, e.chars, e.linked) for x, e in nodes.items()), *((x, c, True, 0, 1, 0, 0) for x, c in texts.items())]
                out["host"].append(host(url))
                out["key"].append(signed(xxhash.xxh64_intdigest(repr(sorted(x[:3] for x in every)))))
                for name, values in zip(("token", "n", "text", "parent", "kind", "chars", "linked"), zip(*every, strict=True), strict=True):
                    out[name].append(values)
            kinds = {"host": pa.string(), "key": pa.int64(), "text": pa.list_(pa.bool_())}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.list_(pa.int64()))) for c in names], names)

    lists = ("token", "n", "text", "parent", "kind", "chars", "linked")
    found = map_arrow(pages.select("url", "html"), run, "host string, key long, token array<long>, n array<long>, text array<boolean>, parent array<long>, kind array<long>, chars array<long>, linked array<long>")
    copies = found.groupBy("host", "key").agg(*(F.any_value(c).alias(c) for c in lists))
    each = copies.select("host", "key", F.explode(F.arrays_zip(*lists)).alias("t")).select("host", "t.*", F.xxhash64("key", "t.n").alias("h"))
    vectors = each.groupBy("host", "token", "text").agg(
        F.count("*").alias("pages"), F.sum(F.shiftrightunsigned("h", 32)).alias("s1"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2"),
        F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    vectors = table(vectors.where(F.col("pages") >= least), "vectors")
    sizes = vectors.where("token = 0 and not text").select("host", F.col("pages").alias("n_pages"))
    valid = vectors.join(sizes, "host").where(F.col("pages") >= share * F.col("n_pages"))
    texts = valid.groupBy("host", "n_pages", "pages", "s1", "s2").agg(F.count("*").alias("size"), F.count_if(~F.col("text")).alias("markup"), F.collect_set(F.when(F.col("text"), F.col("token"))).alias("texts"))
    texts = texts.where("size > 1 and markup > 0 and n_pages >= 10").groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("texts"))

    def deduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = {r.token: (r.parent, r.kind, (r.pages, r.s1, r.s2), r.chars, r.linked) for r in rows.itertuples() if r.token}
        template = nest(nodes)
        return pd.DataFrame({"host": [key[0]], "n_pages": [int(rows["n_pages"].iloc[0])], "main": pd.array([main_slot(nodes, template)], "Int64"), "classes": [len({nodes[x][2] for x in template})]})

    markup = valid.where("not text").groupBy("host").applyInPandas(deduce, "host string, n_pages long, main long, classes int")
    return markup.join(texts, "host", "left").select("host", "n_pages", F.coalesce("texts", F.array().cast("array<long>")).alias("texts"), "main", "classes")


def main_text(pages: DataFrame, id_col: str, url_col: str, html_col: str, broadcast_bytes: int = 16 << 20, **how) -> DataFrame:
    """(id, url, text, n_chars, n_template, slotted, declared) of every row: the article's text from the whole html.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one space; nothing is capped.  `slotted` tells that the text is the
    main slot of the host's template, else it comes from elements and their names; `declared` is the
    language that the html element names, or null.  Templates are broadcast if they
    measure at most `broadcast_bytes`, else pages meet theirs in a shuffled join, whose skewed
    hosts the adaptive execution splits.

    A null or empty html gives an empty text.  A null url belongs to the host "".  Repeated
    rows each give a row; extra columns are ignored; an empty table gives no rows.
    """
    given = own_names(pages, id=id_col, url=url_col, html=html_col)
    found = table(templates(given, **how), "templates")
    size = found.agg(F.sum(64 + F.octet_length("host") + 8 * F.size("texts"))).first()[0] or 0
    name = F.lower(F.regexp_extract("url", r"^(?:.*?://)?(?:[^/?#]*@)?([^/?#:@]*)", 1))
    found = found.select("host", "texts", "main")
    joined = given.withColumn("host", F.coalesce(name, F.lit(""))).join(F.broadcast(found) if size <= broadcast_bytes else found, "host", "left").select("id", "url", "html", "texts", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [page_text(html or "", set(template or ()), main) for html, template, main in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            texts = [x[0] for x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.bool_()), pa.array([m[1] if (m := _LANG.search(html or "")) else None for html in batch.column(2).to_pylist()], pa.string())],
                ["id", "url", "text", "n_chars", "n_template", "slotted", "declared"],
            )

    kind = given.schema["id"].dataType.simpleString()
    return map_arrow(joined, run, f"id {kind}, url string, text string, n_chars long, n_template long, slotted boolean, declared string")
