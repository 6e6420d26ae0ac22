"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements with the same path of tags, classes and
ids are one node. A node's importance is a composite of two entropies over the pages that have
it: how much its child elements differ (presentation) and how much its blocks of text differ
(content). What a site repeats on every page has hardly any; articles differ from page to page.
A prior for the names of elements (`nav`, `class="cookie-banner"`) makes branches unimportant
that say what they are, which small hosts need, where nothing repeats often enough. Branches of
low importance go from each page.

Pages are parsed once in Arrow batches; the tree is built by aggregations over narrow rows of
hashes, so that a host may hold any share of all pages, and no text is shuffled but by a join
of pages with verdicts that grow with the number of page shapes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, staged

#: A branch goes if its importance is under this share of what the host's texts have on average.
THRESHOLD = 0.6
#: Pages that must have a node before entropy says anything of it.
LEAST_PAGES = 4
#: Weight of what lies below a node against its own presentation, to the power of its child styles.
ATTENUATION = 0.9
#: Elements nested deeper than this count as part of their ancestor at this depth.
DEPTH = 64
#: Share of a page's unnamed text that a candidate for the article must hold.
SHARE = 0.25

# HTML elements, and the words by which sites name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = set("applet audio button canvas datalist dialog embed frame head iframe map menu noframes noscript object option script select style svg template textarea title video".split())
CHROME = set("aside footer form nav".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may make up an article; with no class or id, below the article, they are its text.
PLAIN = HEADINGS | set("blockquote caption dd details div dl dt figcaption figure header hgroup li ol p pre section summary table tbody td tfoot th thead tr ul".split()) - {"div", "section"}
#: What an element closes when it starts: the first of these that is open, up to the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements inside of which an end tag finds no element outside.
FENCES = {"td", "th", "table", "caption", "html"}
#: Elements whose boundaries only separate words: a row of a table is one block.
CELLS = {"td", "th"}
NOISE_WORDS = set("""
ad ads adsense adslot adbox advert adverts advertisement advertisements advertising anzeige banner breadcrumb breadcrumbs byways
comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus dropdown foot footer gdpr kommentare legal
login masthead menu menus modal nav navbar navi navigation newsletter notice notices notification outbrain overlay pager pagination paywall
popup print promo promos promoted promotion publicidad publicite rail recommended recirculation related replies reply respond reviews
search share sharing shares sidebar sidebars signin signup sitemap skip skiplink social sponsor sponsored sponsors subscribe subscription
taboola teaser teasers toast toolbar topbar tracking trending werbung widget widgets
""".split())
NOISE_ENDS = ("sidebar", "footer", "navbar", "menu", "comments", "banner", "newsletter", "popup")
NOISE_STARTS = ("advert", "cookie", "sponsor", "newsletter")
#: Names that are chrome outside of an article and part of it inside.
HEAD_WORDS = {"header", "head"}
#: The word after one of these says what an element has, not what it is.
HAVING = set("category format has have hide is no not show status tag topic type with without".split())
CONTENT_WORDS = set("article articlebody body content entry main maincontent markdown post postbody prose story text".split())

WORDS = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"[0-9]{2,}")  # numbers of articles, not of columns
BROKEN = re.compile(r"<[A-Za-z/!?]")
UNDISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@lru_cache(maxsize=1 << 14)
def words_of(names: str) -> frozenset[str]:
    """Words of class and id that say what an element is."""
    words = WORDS.findall(HUMPS.sub(" ", names).lower())
    return frozenset(word for before, word in zip(["", *words], words) if before not in HAVING and word not in HAVING)


@lru_cache(maxsize=1 << 14)
def is_noise_name(names: str) -> bool:
    words = words_of(names)
    return bool(words & NOISE_WORDS) or any(w.endswith(NOISE_ENDS) or w.startswith(NOISE_STARTS) for w in words)


def hashed(*parts: object) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(repr(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def child_of(parent: int, signature: str) -> int:
    return hashed(parent, signature)


#: Kinds of candidates for the article, best first.
ARTICLE, ARTICLE_BODY, MAIN, NAMED = 1, 2, 4, 8


class Open:
    """An element that is open."""

    __slots__ = ("tag", "node", "path", "unseen", "named_noise", "inside", "link", "judged", "block")

    def __init__(self, tag: str, node: int, path: tuple[int, ...], of: Open | None, block: bool):
        self.tag, self.node, self.path, self.block = tag, node, path, block
        self.unseen = of.unseen if of else False
        self.named_noise = of.named_noise if of else None
        self.inside = of.inside if of else 0
        self.link = tag == "a" or bool(of and of.link)
        self.judged = of.judged if of else True


class Page(HTMLParser):
    """Blocks and nodes of one page.

    ``blocks`` holds [node, text, flags, linked characters, judged, noise element, tag];
    ``children`` the child signatures of each node, ``paths`` its ancestors and itself.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        root = hashed("page")
        self.stack = [Open("", root, (root,), None, True)]
        self.children: dict[int, list[str]] = {root: []}
        self.paths: dict[int, tuple[int, ...]] = {root: (root,)}
        self.blocks: list[list] = []
        self.parts: list[tuple[str, bool]] = []
        self.kept_noise: set[int] = set()  # named noise elements that turned out to hold the page's heading
        self.elements = 0
        self.feed(html)
        if BROKEN.match(self.rawdata):  # a tag or comment that never ends
            self.rawdata = ""
        self.close()
        self.flush()

    # -- blocks

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].unseen:
            self.parts.append((data, self.stack[-1].link))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(part for part, _ in self.parts).split())
        linked = sum(len("".join(part.split())) for part, link in self.parts if link)
        self.parts = []
        if text:
            at = self.stack[-1]
            self.blocks.append([at.node, text, at.inside, linked, at.judged, at.named_noise, at.tag])

    # -- elements

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush() if tag == "hr" else self.handle_data(" ")
            return
        if tag in INLINE:
            self.push_inline(tag, attrs)
            return
        self.imply_ends(tag)
        if tag in CELLS:
            self.handle_data(" ")
        else:
            self.flush()
        self.push_block(tag, dict(reversed(attrs)))

    def imply_ends(self, tag: str) -> None:
        """Close what the start of a block closes: an open paragraph, an open item of the same list."""
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].block:
                if self.stack[place].tag == "p" or (tag in HEADINGS and self.stack[place].tag in HEADINGS):
                    self.pop_to(place)
                break
        closed, bounds = CLOSES.get(tag, ((), ()))
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag in closed:
                self.pop_to(place)
                break
            if not closed or self.stack[place].tag in bounds:
                break

    def pop_to(self, place: int) -> None:
        """Close the element at ``place`` of the stack with all in it."""
        if all(not e.block or e.tag in CELLS for e in self.stack[place:]):
            if self.stack[place].tag in CELLS:
                self.handle_data(" ")
        else:
            self.flush()
        del self.stack[place:]

    def push_inline(self, tag: str, attrs: list) -> None:
        of = self.stack[-1]
        new = Open(tag, of.node, of.path, of, False)
        if attrs and not new.unseen:
            names = " ".join(value for key, value in attrs if key in ("class", "id") and value)
            new.unseen = is_hidden(attrs) or (bool(names) and is_noise_name(names))
        self.stack.append(new)

    def push_block(self, tag: str, attrs: dict) -> None:
        of = self.stack[-1]
        names = " ".join(value for key in ("class", "id") if (value := attrs.get(key)))
        signature = f"{tag} {DIGITS.sub('0', names)}" if names else tag
        known = self.children[of.node]
        if not known or known[-1] != signature:
            known.append(signature)
        if len(of.path) >= DEPTH:
            node, path = of.node, of.path
        else:
            node = child_of(of.node, signature)
            path = self.paths.get(node) or (*of.path, node)
            self.paths[node] = path
            self.children.setdefault(node, [])
        new = Open(tag, node, path, of, True)
        self.elements += 1
        role = (attrs.get("role") or "").lower()
        frame = tag in ("html", "body", "article", "main")
        if not new.unseen:
            chrome = tag in UNSEEN or tag in CHROME or role in CHROME_ROLES or is_hidden(attrs.items())
            new.unseen = chrome or (tag == "header" and not new.inside)
        if names and not new.unseen and tag not in ("html", "body"):
            words = words_of(names)
            if is_noise_name(names) or (not new.inside and words & HEAD_WORDS and not frame):
                new.named_noise = new.named_noise or self.elements
            elif words & CONTENT_WORDS and not frame:
                new.inside |= NAMED
        if tag == "h1" and new.named_noise and not self.is_head(new):
            self.kept_noise.add(new.named_noise)
        if tag == "article":
            new.inside |= ARTICLE
        elif tag == "main" or role == "main":
            new.inside |= MAIN
        elif "articlebody" in (attrs.get("itemprop") or "").lower():
            new.inside |= ARTICLE_BODY
        new.judged = not (new.inside & ARTICLE and (tag == "article" or (tag in PLAIN and not names and not of.judged)))
        self.stack.append(new)

    def is_head(self, element: Open) -> bool:
        """Whether a heading lies in a part that only heads the site."""
        return not element.inside & (ARTICLE | ARTICLE_BODY | MAIN)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        if tag == "p" and not any(e.tag == "p" for e in self.stack):
            self.flush()
            return
        inline = tag in INLINE
        for place in range(len(self.stack) - 1, 0, -1):
            element = self.stack[place]
            if element.tag == tag or (tag in HEADINGS and element.tag in HEADINGS):
                self.pop_to(place)
                return
            if (inline and element.block) or (element.tag in FENCES and tag not in FENCES | {"tr", "tbody", "thead", "tfoot", "body"}):
                return

    # -- verdicts of the page alone

    def chosen(self) -> list[tuple[int, str | None, str]]:
        """(node, text or None, text) of each block; text is None where the prior leaves it out."""
        noise = [b[5] is not None and b[5] not in self.kept_noise for b in self.blocks]
        size = lambda flag: sum(len(b[1]) for b, bad in zip(self.blocks, noise) if not bad and (b[2] & flag or not flag))
        total = size(0)
        root = next((flag for flag in (ARTICLE, ARTICLE_BODY, MAIN, NAMED) if size(flag) > SHARE * total), 0)
        out = []
        for (node, text, inside, linked, judged, _, tag), bad in zip(self.blocks, noise):
            is_menu = root in (0, MAIN, NAMED) and tag not in HEADINGS and tag != "p" and linked >= len(text.replace(" ", ""))
            keeps = not bad and (not root or inside & root) and not is_menu
            out.append((node, text if keeps else None, text, judged or root != ARTICLE))
        return out


def is_hidden(attrs) -> bool:
    return any(key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and UNDISPLAYED.search(value)) for key, value in attrs)


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname or None if url else None
    except ValueError:
        return None


NODE = pa.struct([("node", pa.int64()), ("style", pa.int64()), ("path", pa.list_(pa.int64()))])
BLOCK = pa.struct([("place", pa.int32()), ("node", pa.int64()), ("feature", pa.int64()), ("chars", pa.int32()), ("judged", pa.bool_()), ("text", pa.string())])
PARSED = "host string, shape long, nodes array<struct<node: long, style: long, path: array<long>>>, blocks array<struct<place: int, node: long, feature: long, chars: int, judged: boolean, text: string>>"


def parse_page(html: str) -> tuple[int, list[dict], list[dict]]:
    """(shape, nodes, blocks) of one page; ``place`` of a block is that of its node in the nodes."""
    page = Page(html)
    nodes = [{"node": node, "style": hashed(*page.children[node]) if page.children[node] else 0, "path": list(page.paths[node])} for node in sorted(page.children)]
    places = {entry["node"]: place for place, entry in enumerate(nodes)}
    blocks = [
        {"place": places[node], "node": node, "feature": hashed(text), "chars": len(text), "judged": judged, "text": kept} for node, kept, text, judged in page.chosen()
    ]
    return hashed(*((n["node"], n["style"]) for n in nodes)), nodes, blocks


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape (hash of all nodes and styles), nodes, blocks.

    Nodes are null where the task has given those of the same shape before.
    """

    def work(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        found = [parse_page(html or "") for html in batch.column(2).to_pylist()]
        nodes = []
        for shape, of_shape, _ in found:
            nodes.append(None if shape in seen else of_shape)
            if len(seen) < SHAPES:
                seen.add(shape)
        arrays = [
            *(batch.column(i) for i in range(2)),
            pa.array(map(host_of, batch.column(1).to_pylist()), pa.string()),
            pa.array([shape for shape, _, _ in found], pa.int64()),
            pa.array(nodes, pa.list_(NODE)),
            pa.array([blocks for _, _, blocks in found], pa.list_(BLOCK)),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "shape", "nodes", "blocks"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(by_slices(work, set), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, {PARSED}")


#: Shapes whose nodes a task remembers to have given; beyond it gives them again.
SHAPES = 100_000


def entropy_share(losses: Column, most: Column) -> Column:
    """Entropy over its greatest value, the logarithm of the pages; 1 where one page says nothing."""
    return F.when(most > 1, losses / F.log(most)).otherwise(F.lit(1.0))


def importances(parsed: DataFrame, shapes: DataFrame) -> DataFrame:
    """host, node, pages, importance, and the host's average importance of text.

    Content: 1 less the mean entropy of the node's distinct blocks over the pages that have it,
    with all blocks below it. Presentation: entropy of its child sequences. Copies of a page
    repeat its blocks but add no distinct ones, so they weigh little.
    """
    styles = shapes.select("host", "pages", F.explode("nodes").alias("n")).groupBy("host", "n.node", "n.style").agg(F.sum("pages").alias("pages"))
    nodes = styles.groupBy("host", "node").agg(
        F.sum("pages").alias("pages"),
        F.count(F.when(F.col("style") != 0, 1)).alias("styles"),
        F.sum(F.col("pages") * F.log("pages")).alias("_plogp"),
    )
    presentation = entropy_share(F.log("pages") - F.col("_plogp") / F.col("pages"), F.col("pages"))
    nodes = nodes.select("host", "node", "pages", "styles", presentation.alias("presentation"))

    on_page = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["feature"].alias("feature"), b["chars"].alias("chars"))))
    features = parsed.where(F.col("host").isNotNull()).select("host", F.explode(on_page).alias("b")).groupBy("host", "b.node", "b.feature", "b.chars").agg(F.count("*").alias("k"))
    leaves = features.groupBy("host", "node").agg(F.count("*").alias("features"), F.sum(F.log("k")).alias("_logk"), F.sum("chars").alias("chars"))
    leaves = leaves.join(nodes.select("host", "node", "pages"), ["host", "node"]).select(
        "host", "node", "features", "chars", F.when(F.col("pages") > 1, F.col("_logk") / F.log("pages")).otherwise(F.lit(0.0)).alias("loss")
    )
    average = leaves.groupBy("host").agg((1 - F.sum(F.col("chars") * F.col("loss") / F.col("features")) / F.sum("chars")).alias("average"))
    paths = shapes.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.node").agg(F.first("n.path").alias("path"))
    above = leaves.join(paths, ["host", "node"]).select("host", F.explode("path").alias("node"), "features", "loss")
    content = above.groupBy("host", "node").agg((1 - F.sum("loss") / F.sum("features")).alias("content"))
    below = F.pow(F.lit(ATTENUATION), F.col("styles"))
    whole = nodes.join(content, ["host", "node"]).join(average, "host")
    return whole.select("host", "node", "pages", ((1 - below) * F.col("presentation") + below * F.col("content")).alias("importance"), "average")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page: the article's blocks in page order, one a line.

    Null html counts as empty and gives an empty text. Rows stand alone: repeated rows and page
    ids give repeated results. A page without a host in its url is judged by itself. Html has no
    length limit, and need not be well formed: unclosed elements end with their parents. Of
    elements nested deeper than 64 levels the text counts as their ancestor's at that depth.
    Ties don't matter, as no order is sought. Other columns are left out, so clashing names do no
    harm. An empty table gives an empty result.

    White space and `<br>` inside a block are one space, a table row is one block. Inside an
    article only branches with a class or id, `div` and `section` are judged by entropy; plain
    paragraphs, lists and tables are its text.
    """
    parsed = staged(parsed_pages(pages), "pages")
    with_host = parsed.where(F.col("host").isNotNull())
    shapes = staged(with_host.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.first("nodes", ignorenulls=True).alias("nodes")), "shapes")
    found = importances(parsed, shapes)

    # A node that too few pages have is judged by the nearest one above it that enough have.
    paths = shapes.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.node").agg(F.first("n.path").alias("path"))
    above = paths.select("host", "node", F.posexplode("path").alias("depth", "above"))
    known = found.where(F.col("pages") >= LEAST_PAGES).withColumnRenamed("node", "above")
    judged = above.join(known, ["host", "above"]).groupBy("host", "node").agg(F.max_by(F.col("importance") < THRESHOLD * F.col("average"), "depth").alias("noise"))
    places = shapes.select("host", "shape", F.posexplode("nodes").alias("place", "n")).select("host", "shape", "place", F.col("n.node").alias("node"))
    flags = places.join(judged.where("noise"), ["host", "node"], "left").groupBy("host", "shape").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("noise", F.lit(False)).alias("noise")))), lambda f: f["noise"]).alias("noises")
    )
    flags = staged(flags.where(F.array_contains("noises", True)), "verdicts")

    kept = F.filter("blocks", lambda b: b["text"].isNotNull() & ~(b["judged"] & F.coalesce(F.get("noises", b["place"]), F.lit(False))))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    whole = parsed.drop("nodes").join(flags, ["host", "shape"], "left")
    return whole.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
