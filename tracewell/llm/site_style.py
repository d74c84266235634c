"""Main text of web pages, by site style trees: what all pages of a host repeat is not their content."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import stored

RESULTS = ("text", "n_chars")
#: Columns that hold a parsed page between the two passes.
STORED = ("parent", "tag", "key", "furniture", "main", "owner", "block", "linked")
TYPES = ("array<int>", "array<string>", "array<long>", "array<byte>", "array<byte>", "array<int>", "array<string>", "array<double>")
#: Share of an element's importance that comes from its children; branches below LEAST are removed.
ATTENUATION, LEAST = 0.9, 0.2
CACHED_PATHS = 200_000

#: Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
    template tfoot th thead tr ul noscript svg math object video audio canvas button""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never content of an article.
FURNITURE = frozenset("""nav aside footer form head dialog menu search select template noscript svg object video audio canvas button script style
    title textarea iframe noembed noframes input label datalist""".split())
FURNITURE_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class names and ids, by what their elements hold.
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr notice notices notification
    notifications alert alerts banner popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related
    recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar widget widgets skip""".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted".split())
#: A class name that starts so says what stands elsewhere.
RELATION_WORDS = frozenset("has with without no not is hide show".split())
MAIN_NAMES = frozenset("""article post entry story content main main-content page-content post-content post-body entry-content article-content
    article-body story-body""".split())
#: A start tag of the first kind ends an open element of the second, up to one of the third.
ENDS = {
    **{t: (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])) for t in ["li"]},
    **{t: (frozenset(["dd", "dt"]), frozenset(["dl"])) for t in ("dd", "dt")},
    **{t: (frozenset(["td", "th"]), frozenset(["table", "tr"])) for t in ("td", "th")},
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    **{t: (frozenset(["option"]), frozenset(["select"])) for t in ("option", "optgroup")},
}
ENDS_PARAGRAPH = BLOCKS - frozenset("option optgroup button select caption td th tr tbody thead tfoot body html head noscript svg math object video audio canvas template".split())
PARAGRAPH_SCOPE = frozenset("button table td th caption object template html".split())
#: Elements that a repeated branch inside an article may be.
GENERIC = frozenset("div section ul ol dl table figure details".split())

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
_SAYS = re.compile(r"class|id|hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}

NONE, HARD, SOFT, HEADER = range(4)  # kinds of furniture


def _attributes(written: str) -> dict[str, str]:
    """Attributes by lower-case name; of equal names the first counts."""
    return {a.lower(): b or c or d for a, b, c, d in reversed(_ATTRIBUTE.findall(written))}


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - 2**63


class Page:
    """The elements of one page in page order, and its blocks of text.

    Only elements that form blocks are nodes, a node's ``key`` is a hash of
    the site and of the names and classes on its path; inline elements only
    say whether their text is an advert or a link. Parsing is tolerant: what
    is not closed ends with its container, and no depth is too deep.
    """

    _paths: dict = {}
    _elements: dict = {}

    def __init__(self, site: str):
        self.parent, self.tag, self.key, self.furniture, self.main = [-1], ["#page"], [self._path(0, "#" + site)], [NONE], [0]
        self.owner: list[int] = []
        self.block: list[str] = []
        self.linked: list[float] = []

    @classmethod
    def parsed(cls, source: str, site: str) -> Page:
        page = cls(site)
        page._read(source)
        return page

    @classmethod
    def loaded(cls, columns: tuple) -> Page:
        """A page from its stored columns."""
        page = cls("")
        for name, values in zip(STORED, columns):
            setattr(page, name, values.tolist())
        return page

    def _path(self, parent: int, name: str) -> int:
        found = self._paths.get((parent, name))
        if found is None:
            if len(self._paths) > CACHED_PATHS:
                self._paths.clear()
            found = self._paths[parent, name] = xxhash.xxh64_intdigest(f"{parent} {name}".encode("utf-8", "surrogatepass")) - 2**63
        return found

    def _element(self, tag: str, written: str) -> tuple[str, int, int]:
        """The name on paths, the kind of furniture and the rank as main content (1 is best, 0 none)."""
        found = self._elements.get((tag, written))
        if found is None:
            if len(self._elements) > CACHED_PATHS:
                self._elements.clear()
            found = self._elements[tag, written] = self._judged(tag, _attributes(written))
        return found

    @staticmethod
    def _judged(tag: str, attributes: dict[str, str]) -> tuple[str, int, int]:
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
        role = attributes.get("role", "").lower()
        kind = HARD if tag in FURNITURE or role in FURNITURE_ROLES or "hidden" in attributes else NONE
        main = 1 if tag == "article" else 2 if tag == "main" or role in ("main", "article") or "articleBody" in attributes.get("itemprop", "") else 0
        words = [w for w in ([x.lower() for x in _WORD.findall(n)] for n in names) if w]
        if not main and tag not in HEADINGS and any(n.lower() in MAIN_NAMES for n in names):
            main = 3
        if kind == NONE and tag not in ("html", "body", "main"):
            said = {x for w in words if w[0] not in RELATION_WORDS for x in ({w[0]} if tag == "article" else w)}
            if said & FURNITURE_WORDS:
                kind = SOFT
            elif tag == "header" or role == "banner" or ("header" in said and tag not in HEADINGS and not main):
                kind = HEADER
        shown = sorted({re.sub(r"\d+", "", n.lower()) for n in names})
        return (f"{tag}.{'.'.join(shown)}" if shown else tag), kind, main

    def _read(self, source: str) -> None:
        open_nodes, open_tags = [0], ["#page"]       # elements that are not closed yet; -1 stands for an inline element
        states = [(0, False, False)]                 # of each: the block element, within a link, within an inline advert
        parts, linked, owner, at = [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.owner.append(owner)
                    self.block.append(text)
                    self.linked.append(min(1.0, linked / len(text)))
                parts.clear()
                linked = 0

        def pop(size: int) -> None:
            nonlocal owner
            if any(n >= 0 for n in open_nodes[size:]):
                flush()
            del open_nodes[size:], open_tags[size:], states[size:]
            owner = states[-1][0]

        def say(raw: str) -> None:
            nonlocal linked
            _, link, advert = states[-1]
            if not advert:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if link:
                    linked += len(text.strip())

        while (begin := source.find("<", at)) >= 0:
            found = _MARKUP.match(source, begin)
            if found is None:
                say(source[at:begin + 1])
                at = begin + 1
                continue
            if begin > at:
                say(source[at:begin])
            at, tag = found.end(), (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag in open_tags:
                    size = len(open_tags) - 1 - open_tags[::-1].index(tag)
                    # an inline end tag closes nothing beyond its block
                    if tag in BLOCKS or all(n < 0 for n in open_nodes[size:]):
                        pop(size)
                continue
            if tag in ENDS:
                closes, limit = ENDS[tag]
                size = cut = len(open_tags)
                while cut > 1 and open_tags[cut - 1] not in limit:
                    cut -= 1
                    if open_tags[cut] in closes:
                        size = cut
                if size < len(open_tags):
                    pop(size)
            elif tag in ENDS_PARAGRAPH and "p" in open_tags:
                size = len(open_tags) - 1 - open_tags[::-1].index("p")
                if not PARAGRAPH_SCOPE.intersection(open_tags[size:]):
                    pop(size)
            if tag == "br":
                parts.append(" ")
                continue
            if tag in RAW:
                closing = _RAW_END[tag].search(source, at)
                at = closing.start() if closing else len(source)
                continue
            written = found[3]
            if tag not in BLOCKS:
                if tag not in VOID and not written.endswith("/"):
                    node, link, advert = states[-1]
                    if tag in FURNITURE:
                        advert = True
                    elif not advert and _SAYS.search(written):
                        attributes = _attributes(written)
                        words = {x.lower() for x in _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
                        advert = "hidden" in attributes or bool(words & ADVERT_WORDS)
                    open_nodes.append(-1)
                    open_tags.append(tag)
                    states.append((node, link or tag == "a", advert))
                continue
            flush()
            if tag in VOID:
                continue
            if tag in ("html", "body") and tag in open_tags:
                continue
            name, kind, main = self._element(tag, written)
            node = len(self.tag)
            key = self._path(self.key[owner], name)
            self.parent.append(owner)
            self.tag.append(tag)
            self.key.append(key)
            self.furniture.append(kind)
            self.main.append(main)
            open_nodes.append(node)
            open_tags.append(tag)
            states.append((node, states[-1][1], states[-1][2]))
            owner = node
        if at < len(source):
            say(source[at:])
        flush()

    def observed(self) -> tuple[int, int, list[int], list[int], list[bool], list[int]]:
        """Hashes of content and outline, the elements, and what they show: element, whether it is a text, hash."""
        children: list[list[int]] = [[] for _ in self.key]
        for i, p in enumerate(self.parent[1:], 1):
            children[p].append(self.key[i])
        styles = {(k, False, _hash(np.array(c, "i8").tobytes())) for k, c in zip(self.key, children)}
        texts = {(self.key[i], True, _hash(text.encode("utf-8", "surrogatepass"))) for i, text in zip(self.owner, self.block)}
        nodes, shown = sorted(set(self.key)), sorted(styles | texts)
        node, is_text, value = zip(*shown)
        return _hash(np.array(shown, "i8").tobytes()), _hash(np.array(nodes, "i8").tobytes()), nodes, node, is_text, value

    def _importance(self, known: dict[int, tuple[float, float, int]]) -> list[float]:
        """Composite importance of every element: its own and, attenuated, the mean of its children and texts."""
        total, count = [0.0] * len(self.tag), [0] * len(self.tag)
        for i in set(self.owner):
            total[i] += known[self.key[i]][1]
            count[i] += 1
        out, has_children = [0.0] * len(self.tag), set(self.parent)
        for i in range(len(self.tag) - 1, -1, -1):
            below = total[i] / count[i] if count[i] else 0.0
            out[i] = below if i not in has_children else (1 - ATTENUATION) * known[self.key[i]][0] + ATTENUATION * below
            if i and (count[i] or i in has_children):
                total[self.parent[i]] += out[i]
                count[self.parent[i]] += 1
        return out

    def main_text(self, known: dict[int, tuple[float, float, int]]) -> str:
        """The blocks of the branches that stay, in page order."""
        importance, size = self._importance(known), len(self.tag)
        hard, soft, header = [False] * size, [False] * size, [False] * size
        for i in range(1, size):
            p, kind = self.parent[i], self.furniture[i]
            hard[i], soft[i], header[i] = hard[p] or kind == HARD, soft[p] or kind == SOFT, header[p] or kind == HEADER
        holds = set(self.owner)
        filled = [i in holds for i in range(size)]
        for i in range(size - 1, 0, -1):
            filled[self.parent[i]] = filled[self.parent[i]] or filled[i]
        in_header = [False] * size
        candidates = [i for i in range(size) if self.main[i] and filled[i] and not hard[i] and not (header[i] and self.main[i] > 1)]
        open_ones = [i for i in candidates if not soft[i]]
        # a container that is named after furniture but holds all there is of main content is not furniture
        candidates = open_ones or [i for i in candidates if self.furniture[i] != SOFT]
        best = min((self.main[i] for i in candidates), default=0)
        roots = {i for i in candidates if self.main[i] == best}
        above = set()
        if not open_ones:
            for i in roots:
                while i > 0 and i not in above:
                    above.add(i)
                    i = self.parent[i]
        stays, inside = [True] * size, [0] * size  # inside: the main branch an element stands in
        for i in range(1, size):
            p, kind = self.parent[i], self.furniture[i]
            inside[i] = inside[p] or (i if i in roots else 0)
            node_imp, _, pages = known[self.key[i]]
            stays[i] = stays[p] and kind != HARD and (kind != SOFT or i in above)
            if inside[i]:
                if kind == HEADER and i != inside[i]:
                    in_header[i] = True
                in_header[i] = in_header[i] or in_header[p]
                root = inside[i]
                if i != root and pages > 1 and self.tag[i] in GENERIC and importance[i] < LEAST <= importance[root]:
                    stays[i] = False
                if in_header[i] and self.tag[i] in HEADINGS:
                    in_header[i] = False
            elif not roots:
                stays[i] = stays[i] and kind != HEADER and not (pages > 1 and importance[i] < LEAST and self.tag[i] not in ("html", "body"))
        menus = set() if roots else self._menus()
        return "\n".join(text for i, text in zip(self.owner, self.block)
                         if stays[i] and not in_header[i] and (inside[i] or not roots) and i not in menus)

    def _menus(self) -> set[int]:
        """Elements whose texts are links only, and that stand in a list of at least two such."""
        texts: dict[int, list[float]] = {}
        for i, share in zip(self.owner, self.linked):
            texts.setdefault(i, []).append(share)
        only = {i for i, shares in texts.items() if min(shares) > 0.9 and self.tag[i] in ("li", "dd", "dt", "td", "div", "option")}
        beside: dict[int, int] = {}
        for i in only:
            beside[self.parent[i]] = beside.get(self.parent[i], 0) + 1
        return {i for i in only if beside[self.parent[i]] > 1}


def site_of(url: Column, page: Column) -> Column:
    """The lower-case host of a URL; a page without one is a site of its own."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.concat(F.lit("?"), F.sha2(page, 256)))


def style_trees(parsed: DataFrame) -> DataFrame:
    """One row (node, pages, presentation, content) per element of all sites' style trees.

    ``parsed`` has a row (page, nodes, node, is_text, value) per page. Pages
    of a site with equal elements and texts count once. presentation is the
    entropy of the sequences of children that an element shows, content is one
    less the mean entropy of its texts over the pages, both to the base of the
    number of pages that have the element; both are 1 if only one has. Pages,
    elements and texts are told apart by 64-bit hashes: two that agree by
    chance blur a count of one site, nothing else.
    """
    pages = parsed.select("page", "nodes", "node", "is_text", "value").dropDuplicates(["page"])
    present = F.transform("nodes", lambda k: F.struct(k.alias("node"), F.lit(None).cast("boolean").alias("is_text"), F.lit(0).cast("bigint").alias("value")))
    shown = F.transform(F.arrays_zip("node", "is_text", "value"), lambda x: F.struct(x["node"].alias("node"), x["is_text"].alias("is_text"), x["value"].alias("value")))
    rows = pages.select(F.explode(F.concat(present, shown)).alias("x")).select("x.*")
    counted = rows.groupBy("node", "is_text", "value").agg(F.count("*").alias("n"))
    summed = counted.groupBy("node").agg(
        F.max(F.when(F.col("is_text").isNull(), F.col("n"))).alias("pages"),
        F.sum(F.when(~F.col("is_text"), F.col("n"))).alias("shown"),
        F.sum(F.when(~F.col("is_text"), F.col("n") * F.log("n"))).alias("shown_log"),
        F.sum(F.when(F.col("is_text"), F.log("n"))).alias("text_log"),
        F.sum(F.when(F.col("is_text"), 1)).alias("texts"))
    base = F.log("pages")
    return summed.select(
        "node", "pages",
        F.when(F.col("pages") > 1, (F.log("shown") - F.col("shown_log") / F.col("shown")) / base).otherwise(F.lit(1.0)).alias("presentation"),
        F.when((F.col("pages") > 1) & (F.col("texts") > 0), 1 - F.col("text_log") / F.col("texts") / base).otherwise(F.lit(1.0)).alias("content"))


def main_text(pages: DataFrame, source: str = "html", url: str = "url") -> DataFrame:
    """Every page with ``text``, its main text, and n_chars, its code points, in place of ``source``.

    The pages of a host are merged into a style tree (``style_trees``); each
    page then takes the importance of its own elements from it, those below
    in a page adding to those above. A branch is removed if its importance is
    low; an element that its name, role or class marks as menu, header,
    footer, side bar, notice, advert, form or comments has none, one marked
    as the article has all, and where a page marks one, nothing outside stays.
    Inside it a list or container is removed if its importance is low while
    that of the article is not. An article's own header keeps its headings.
    Character references are decoded, white space (Unicode's) within a block
    becomes one space, blocks are joined by line feeds in page order.

    A NULL page is an empty one and gives an empty text; a NULL or unreadable
    URL makes the page a site of its own; repeated rows give one row each and
    count once in their tree. Pages are parsed once, in one pass over any
    length and nesting, and kept parsed in the shared folder. An empty table
    gives an empty result. Pages then meet the importance of their outline
    (the set of their elements), of which Spark broadcasts a small table and
    merges a large one.
    """
    @F.pandas_udf(", ".join(["page long, outline long, nodes array<long>, node array<long>, is_text array<boolean>, value array<long>",
                             *[f"{c} {t}" for c, t in zip(STORED, TYPES)]]))
    def parse(sources: pd.Series, sites: pd.Series) -> pd.DataFrame:
        read = [Page.parsed(s, site) for s, site in zip(sources, sites)]
        rows = [(*p.observed(), *[getattr(p, c) for c in STORED]) for p in read]
        return pd.DataFrame(rows, columns=["page", "outline", "nodes", "node", "is_text", "value", *STORED])

    @F.pandas_udf("string")
    def extract(*columns: pd.Series) -> pd.Series:
        out = []
        for nodes, own, content, many, *page in zip(*columns):
            importance = dict(zip(nodes.tolist(), zip(own.tolist(), content.tolist(), many.tolist())))
            out.append(Page.loaded(page).main_text(importance))
        return pd.Series(out, dtype=object)

    whole = F.coalesce(F.col(source).cast("string"), F.lit(""))
    others = [c for c in pages.columns if c not in (*RESULTS, source)]
    site = site_of(F.col(url).cast("string"), whole)
    parsed = stored(pages.select(*others, parse(whole, site).alias("_t_p")), "zstd")
    seen = parsed.select("_t_p.*")
    outlines = seen.select("outline", "nodes").dropDuplicates(["outline"]).select("outline", F.explode("nodes").alias("node"))
    each = F.sort_array(F.collect_list(F.struct("node", "presentation", "content", F.col("pages").cast("bigint").alias("pages"))))
    known = stored(outlines.join(style_trees(seen), "node").groupBy("outline").agg(each.alias("k")))
    maps = known.select(F.col("outline").alias("_t_outline"), F.col("k").alias("_t_known"))
    of_nodes = [F.col(f"_t_known.{c}") for c in ("node", "presentation", "content", "pages")]
    text = extract(*of_nodes, *[F.col(f"_t_p.{c}") for c in STORED])
    joined = parsed.join(maps, F.col("_t_p.outline") == F.col("_t_outline"))
    return joined.select(*others, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
