"""HTML extraction: the main text of pages, by roles of elements and by wrappers induced from pages of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
NO_TEXT = frozenset("script style noscript template nav footer aside form button select textarea input svg math iframe object canvas audio video dialog menu search head title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NO_WORD = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion nav navbar navigation menu topbar breadcrumb breadcrumbs sidebar sidenav widget widgets footer masthead comment comments commentlist discussion reply replies respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar skip copyright".split())
SHAPING = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
NEUTRAL = frozenset("area bar block body bottom box btn button buttons container content content1 form group header heading holder icons id inner item items left links list main outer page posts primary right row secondary section slot site text title top unit wrap wrapper".split())
MODELS = 64  # trees of model pages that a task keeps
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "label", "children", "out", "main", "home")

    def __init__(self, tag: str, attrs: list, parent: Node | None):
        inside = bool(parent and (parent.main or parent.tag == "article"))
        out, main, self.label = kind_of(tag, tuple(attrs), inside)
        self.tag, self.children, self.home = tag, [], None
        self.out = out or bool(parent and parent.out)
        self.main = inside or main and not self.out


@lru_cache(4096)
def kind_of(tag: str, attrs: tuple, inside: bool) -> tuple[bool, bool, str]:
    """Whether such an element holds no main text, whether it marks main text, and its label; inside: of a main element."""
    given = {k: v or "" for k, v in attrs }
    names = f"{given.get('class', '')} {given.get('id', '')}"
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    named = any(map(says_no, names.split())) and tag not in ("html", "body", "main")
    out = tag in NO_TEXT or role in NO_ROLE or hidden or named or (tag == "header" and not inside)
    main = tag in ("article", "main") or role in ("main", "article")
    return out, main, f"{tag}.{'.'.join(sorted(given.get('class', '').split()))}"


def says_no(name: str) -> bool:
    """Whether a class or id names a part that holds no main text, and nothing else: share-buttons, not share-price."""
    words = {w.lower() for w in WORDS.findall(name) if not w.isdigit()}
    return re.sub("[_-]", "", name.lower()) in NO_WORD or bool(words & NO_WORD) and words <= NO_WORD | NEUTRAL


class Tree(HTMLParser):
    """The elements of a page, where ends that HTML lets one leave out are put in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", [], None)
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shut = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCK else ())
        for k in range(len(self.open) - 1, 0, -1) if shut else ():
            if self.open[k].tag in shut:
                del self.open[k:]
                if tag not in CLOSED_BY:
                    break
            elif self.open[k].tag in SCOPE:
                break
        node = Node(tag, [x for x in attrs if x[0] in SHAPING] if attrs else attrs, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def folded(node: Node) -> list[Node]:
    """The child elements of which no one follows one of the same label: runs of equal siblings are one place."""
    found: list[Node] = []
    for child in node.children:
        if isinstance(child, Node) and (not found or found[-1].label != child.label):
            found.append(child)
    return found


def align(page: Node, model: Node, path: str = "") -> None:
    """Simple tree matching: gives each element of the page the place of the model's element that it matches.

    Roots match; children are matched in order so that most elements match in the subtrees (one table of best sums for
    each pair of nodes). Elements of equal label in a run share their place. What has no match gets none.
    """
    todo = [(page, model, path)]
    memo: dict[tuple[int, int], int] = {}

    def size(a: Node, b: Node) -> int:
        """Elements in the best matching of two subtrees; the pairs below come first, on a stack of their own."""
        wait = [(a, b, False)]
        while wait:
            x, y, ready = wait.pop()
            key = (id(x), id(y))
            if key in memo:
                continue
            if x.label != y.label:
                memo[key] = 0
            elif ready:
                memo[key] = 1 + table(x, y)[-1][-1]
            else:
                wait.append((x, y, True))
                wait += [(i, j, False) for i in folded(x) for j in folded(y) if i.label == j.label and (id(i), id(j)) not in memo]
        return memo[id(a), id(b)]

    def table(a: Node, b: Node) -> list[list[int]]:
        xs, ys = folded(a), folded(b)
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + (memo[id(x), id(y)] if x.label == y.label else 0))
        return m

    while todo:
        a, b, place = todo.pop()
        a.home = place
        size(a, b)
        xs, ys, m = folded(a), folded(b), table(a, b)
        i, j, partner = len(xs), len(ys), {}
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                partner[id(xs[i])] = (ys[j], f"{place}/{j}")
        run = None
        for child in a.children:
            if isinstance(child, Node):
                run = partner.get(id(child)) or (run if run and run[0].label == child.label else None)
                if run:
                    todo.append((child, *run))


def blocks(root: Node) -> list[tuple[str, str, bool]]:
    """The page's blocks in order: text (white space as one space), place in the wrapper, and whether in a main element.
    Blocks of elements that hold no main text are left out."""
    found: list[tuple[str, str, bool]] = []
    buffer: list[str] = []
    owner = [root]

    def flush() -> None:
        text = SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            found.append((text, owner[0].home or "", owner[0].main))
        buffer.clear()

    # Depth first without recursion, for deep pages: entries are a text or an element and whether it starts or ends.
    todo: list[tuple] = [(root, True, root)]
    while todo:
        item, start, block = todo.pop()
        if isinstance(item, str):
            if not buffer:
                owner[0] = block
            buffer.append(item)
            continue
        breaks = item.tag in BLOCK or item.tag == ""
        if breaks:
            flush()
        if not start or item.out:
            continue
        if item.tag == "br":
            buffer.append(" ")
        if breaks:
            todo.append((item, False, block))
        block = item if breaks else block
        todo.extend((c, True, block) for c in reversed(item.children))
    flush()
    return found


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def slot_hash(home: str, text: str) -> int:
    """Of a block's text at a place of the wrapper."""
    return signed(xxhash.xxh64_intdigest(f"{home}\0{text}".encode("utf-8", "surrogatepass"))) or 1


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?s)(.*?)://([^/?#]*)", 2), F.lit("")))


def extract(pages: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """page_id, url, text: the main text of each page, its blocks joined by one line feed; empty if there is none.

    Each host has a model page, its page of the smallest page_id (ties: html). Every page is aligned with its host's model
    by simple tree matching. A block's text that at one place of the model stands in over `share` of the host's distinct
    pages, and in `least` at least, is constant: template, and dropped. Of the varying slots, those that hold no main text
    by their role (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments; known by element,
    ARIA role, or a class or id that names nothing else) are dropped; if the page marks main elements, only what is in
    these stays. Copies of a page count once, lest they make their own article constant.

    Null html is empty. Repeated page_ids are rows of their own; a null url has the empty host; other columns are ignored.
    Long and deep pages are taken whole; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    first = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.xxhash64("html").alias("c"))
    models = written(rows.filter("html is not null").groupBy("host").agg(F.min_by("html", first).alias("model")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = lru_cache(MODELS)(lambda model: Tree(model).root)
        for batch in batches:
            seen, slots, texts, mains = [], [], [], []
            for html, model in zip(*(c.to_pylist() for c in batch.columns[3:])):
                tree = Tree(html or "").root
                if model:
                    align(tree, trees(model))
                found = blocks(tree)
                seen.append(None if html is None else signed(xxhash.xxh64_intdigest(html)))
                texts.append([text for text, _, _ in found])
                slots.append([slot_hash(home, text) for text, home, _ in found])
                mains.append([main for _, _, main in found])
            parts = (pa.array(seen, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int64())), pa.array(mains, pa.list_(pa.bool_())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], ["page_id", "url", "host", "page", "text", "slot", "main"])

    kind = pages.schema["page_id"].dataType.simpleString()
    whole = rows.join(models, "host", "left").select("page_id", "url", "host", "html", "model")
    parsed = written(whole.mapInArrow(run, f"page_id {kind}, url string, host string, page long, text array<string>, slot array<long>, main array<boolean>"))

    each = F.explode(F.array_distinct(F.concat("slot", F.array(F.lit(0).cast("long")))))  # 0: the page itself
    votes = parsed.filter("page is not null").select("host", each.alias("slot"), "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"))
    votes = written(votes.filter((F.col("n") >= least) | (F.col("slot") == 0)))
    sizes = votes.filter("slot = 0").select("host", F.col("n").alias("pages"))
    # Each is in over `share` of the pages, so there are no more of them than 1 / share times the blocks of a page.
    constant = written(votes.filter("slot <> 0").join(sizes, "host").filter(F.col("n") > share * F.col("pages")).groupBy("host").agg(F.collect_list("slot").alias("constant")))
    inside = F.exists("main", lambda x: x)
    varying = lambda x: (x["main"] | ~F.col("inside")) & ~F.coalesce(F.array_contains("constant", x["slot"]), F.lit(False))
    left = parsed.join(constant, "host", "left").withColumns({"inside": inside, "blocks": F.arrays_zip("text", "slot", "main")})
    return left.select("page_id", "url", F.array_join(F.transform(F.filter("blocks", varying), lambda x: x["text"]), "\n").alias("text"))
