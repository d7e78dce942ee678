"""Main text of web pages with a site style tree.

The pages of a host are merged into a tree of style nodes: a node is the path of (tag, class) pairs from the root,
and equal siblings are one. The distinct pages of the host that have a node give it two entropies, each to the base of their
number: of the sequences of its children's styles (presentation), and of each text that stands in it, over the
pages that have that text (content). A text of one page has an entropy of 0, one of every page 1. The importance of a branch of a page is
the greater of its presentation's entropy and of the part of its characters that is the page's own, sum(n * (1 - entropy)) /
sum(n). Branches of low importance are the site's template and are removed, whatever their tag or class; only ``html``,
``body``, ``article`` and ``main`` are never removed as a whole.

On few pages repetition says little, so entropies are multiplied by m / (m + c) for m pages, c being ``DOUBT``. Markup that names its
own role (navigation, adverts, forms ...) is evidence as well, for what differs from page to page without being the article: such branches go, unless they
hold the article itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, free, ship, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
#: Never text of an article.
_NEVER = {"head", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "button", "select", "datalist", "textarea", "title", "xmp", "noembed"}
#: Tags and ARIA roles that say what they hold.
_SAYS = {"nav", "footer", "aside", "dialog", "menu"}
_ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of classes and ids that name a role; "has-sidebar" and "no-ads" tell of a page, not of the branch.
_ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?nav|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|notices?|popup|modal|overlay|comments?|disqus|replies|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|widget|pagination|pager|skip-?link)(?:$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
_ABOUT = re.compile(r"(?:^|\s)(?:has|have|no|not|with|without|is|can)[_-]\S*", re.I)
_ROOTS = {"html", "body", "article", "main"}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "dd", "dt"}
#: A branch goes if its importance is below this.
IMPORTANCE = 0.1
#: How many pages' worth of doubt there is that repetition means a template: of other branches, and of those that mostly hold prose.
DOUBT, DOUBT_PROSE = 0.5, 2.0
#: Texts of less entropy than this count as a page's own.
LEAST_ENTROPY = 0.5
#: Rows of the trees (about 60 bytes each) that may be broadcast; more are joined to the pages by host in a shuffle.
BROADCAST_ROWS = 200_000
_MASK, _B = (1 << 64) - 1, 0x100000001B3
NEVER, SAYS, NAMED = 1, 2, 3


def _h(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """The elements of a page in the order in which they open; element 0 is the page.

    ``pieces`` are (element, text), or (element, None) where a block begins or ends. There is no recursion, so nesting may be of any depth.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.role, self.block, self.kids, self.last = [""], [0], [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(html)

    def _add(self, tag: str, up: int, path: int, role: int) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(path)
        self.role.append(role)
        self.block.append(self.block[up] if tag in _INLINE else k)
        self.kids.append(0)
        self.last.append(0)
        return k

    def _read(self, html: str) -> None:
        stack, opened = [0], {}  # opened: tag -> how many are open
        tags, pieces = self.tag, self.pieces
        pos, size = 0, len(html)

        def close(k: int) -> None:
            while len(stack) > k:
                node = stack.pop()
                opened[tags[node]] -= 1
                if tags[node] not in _INLINE:
                    pieces.append((node, None))

        while pos < size:
            m = _TOKEN.search(html, pos)
            at = m.start() if m else size
            if at > pos:
                raw = html[pos:at]
                pieces.append((stack[-1], unescape(raw) if "&" in raw else raw))
            if not m:
                break
            pos = m.end()
            tag = m.group(2)
            if not tag:
                if m.group().startswith("<![CDATA["):
                    pieces.append((stack[-1], m.group()[9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if m.group(1):
                if opened.get(tag):
                    k = len(stack) - 1
                    while tags[stack[k]] != tag:
                        k -= 1
                    close(k)
                continue
            if tag in _VOID:
                if tag == "br":
                    pieces.append((stack[-1], " "))
                elif tag == "hr":
                    pieces.append((stack[-1], None))
                continue
            if tag in _CLOSES_P and opened.get("p"):
                k = len(stack) - 1
                while tags[stack[k]] != "p":
                    k -= 1
                close(k)
            for other in _SIBLING.get(tag) or ():
                if opened.get(other):
                    k, stop = len(stack) - 1, _SCOPE.get(tag, ())
                    while tags[stack[k]] != other and tags[stack[k]] not in stop and k:
                        k -= 1
                    if tags[stack[k]] == other:
                        close(k)
            up = stack[-1]
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m.group(3))} if m.group(3).strip() else {}
            cls = attrs.get("class", "")
            sig = _h(tag + "." + " ".join(sorted(cls.split())) if cls else tag)
            if tag not in _INLINE:
                if sig != self.last[up]:  # equal siblings are one
                    self.kids[up], self.last[up] = (self.kids[up] * _B + sig) & _MASK, sig
                pieces.append((up, None))
            if m.group(3).endswith("/") and tag in ("svg", "path"):
                continue
            node = self._add(tag, up, ((self.path[up] ^ sig) * _B + 0x9E37) & _MASK, _role(tag, attrs, cls))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(node)
            if tag in _RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, pos)
                pos = end.start() if end else size
        close(1)

    def _up(self, own: list) -> list:
        """Sums over branches."""
        out, parent = own.copy(), self.parent
        for k in range(len(out) - 1, 0, -1):
            out[parent[k]] += out[k]
        return out

    def _down(self, own: list[bool]) -> list[bool]:
        """What holds for an element or one around it."""
        out, parent = own.copy(), self.parent
        for k in range(1, len(out)):
            out[k] = out[k] or out[parent[k]]
        return out

    def texts(self) -> list[tuple[int, str]]:
        """(block, text) of each run of text without a block's edge in it; white space is one space."""
        out, run, at = [], [], 0
        never = self._down([r == NEVER for r in self.role])
        for node, t in [*self.pieces, (0, None)]:
            if t is None:
                if run and (s := " ".join("".join(run).split())):
                    out.append((at, s))
                run = []
            elif not never[node]:
                if not run:
                    at = self.block[node]
                run.append(t)
        return out

    def text(self, tree: Tree | None = None) -> str:
        """The main text."""
        tag, role, n = self.tag, self.role, len(self.tag)
        own = [0] * n
        for node, t in self.pieces:
            if t is not None:
                own[node] += len(t) - t.count(" ")
        gone = self._down([r in (NEVER, SAYS) for r in role])
        own = [0 if g else k for g, k in zip(gone, own, strict=True)]
        if any(r == NAMED for r in role):
            size = self._up(own)
            # Branches named after a role go unless they hold more than half of the articles or, where there is none, of the page.
            spoken = [tag[k] in ("article", "main") and role[k] == 0 for k in range(n)]
            inside = self._down(spoken)
            held = self._up([own[k] if inside[k] else 0 for k in range(n)])
            some = held if held[0] else size
            named = [role[k] == NAMED and not 2 * some[k] > some[0] for k in range(n)]
            if held[0]:
                named = [x or (role[k] == NAMED and inside[k] and not spoken[k] and 2 * size[k] <= held[0]) for k, x in enumerate(named)]
            gone = [a or b for a, b in zip(gone, self._down(named), strict=True)]
        if tree is not None:
            low = self._down(self._low(tree))
            if any(k and not g and not w for k, g, w in zip(own, gone, low, strict=True)):  # else the page repeats as a whole
                gone = [a or b for a, b in zip(gone, low, strict=True)]
        own = [0 if g else k for g, k in zip(gone, own, strict=True)]
        main = self._down([t == "main" for t in tag])
        article = self._down([t == "article" for t in tag])
        in_main, in_article = sum(k for k, x in zip(own, main, strict=True) if x), sum(k for k, x in zip(own, article, strict=True) if x)
        # The articles are the page, unless they are less than a third of it, as teasers are.
        if in_article and 3 * in_article >= (in_main or sum(own)):
            gone = [g or not x for g, x in zip(gone, article, strict=True)]
        elif in_main:
            gone = [g or not x for g, x in zip(gone, main, strict=True)]
        return " ".join("".join("\n" if t is None else t for node, t in self.pieces if t is None or not gone[node]).split())

    def _low(self, tree: Tree) -> list[bool]:
        """Branches of low importance."""
        n = len(self.tag)
        total, mine, prose = [0.0] * n, [0.0] * n, [0.0] * n
        for k, t in self.texts():
            total[k] += len(t)
            h, m = tree.entropy.get(self.path[k] ^ _h(t), (0.0, 1))
            w = 1 - h * m / (m + (DOUBT_PROSE if self.tag[k] in _PROSE else DOUBT))
            mine[k] += len(t) * w
        total, mine = self._up(total), self._up(mine)
        return [k > 0 and total[k] > 0 and self.tag[k] not in _ROOTS and mine[k] < IMPORTANCE * total[k] and self.path[k] in tree.uniform for k in range(n)]


def _role(tag: str, attrs: dict[str, str], cls: str) -> int:
    if tag in _NEVER or "hidden" in attrs:
        return NEVER
    if tag in _SAYS or attrs.get("role") in _ARIA:
        return SAYS
    if tag in ("form", "header") or attrs.get("role") == "form":
        return NAMED
    if tag in ("article", "main"):
        return NAMED if cls and _COMMENT.search(_ABOUT.sub(" ", cls)) else 0
    if tag not in ("html", "body") and any(a and _ROLE.search(_ABOUT.sub(" ", a)) for a in (cls, attrs.get("id") or "")):
        return NAMED
    return 0


class Tree:
    """What the pages of one host need of their style tree."""

    __slots__ = ("entropy", "uniform")

    def __init__(self) -> None:
        self.entropy: dict[int, tuple[float, int]] = {}  #: path ^ text -> (entropy of the text over the pages, pages that have the path)
        self.uniform: set[int] = set()  #: paths whose presentation has low entropy

    def add(self, kind: int, key: int, h: float, m: int) -> None:
        if kind:
            self.entropy[key & _MASK] = (h, m)
        else:
            self.uniform.add(key & _MASK)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, kind, key, h, m): paths of uniform presentation (kind 0), and texts of many pages by path (kind 1). pages: (host, html)."""
    page = pages.select("host", "html", F.xxhash64("host", "html").alias("page"))
    again = page.groupBy("page").agg(F.count("*").alias("c")).where("c > 1").select(F.col("page").alias("p"), "c")
    again = cut(again, "again")
    small = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    page = page.join(small, F.col("page") == F.col("p"), "left").select("host", "html", (1 / F.coalesce("c", F.lit(1))).alias("w"))

    def emit(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for at in range(0, len(block), 512):
                out = []
                for host, html, w in block.iloc[at : at + 512].itertuples(index=False):
                    page = Page(html)
                    looks: dict[int, int] = {}
                    for k, (tag, path, kids) in enumerate(zip(page.tag, page.path, page.kids, strict=True)):
                        if k and tag not in _INLINE and tag not in _RAW:
                            looks[path] = (looks.get(path, 0) * _B + kids) & _MASK
                    out += [(host, 0, _signed(p), _signed(x), w) for p, x in looks.items()]
                    out += [(host, 1, _signed(p), _signed(x), w) for p, x in {(page.path[k], page.path[k] ^ _h(t)) for k, t in page.texts()}]
                yield pd.DataFrame(out, columns=["host", "kind", "path", "value", "w"])

    seen = page.mapInPandas(emit, "host string, kind int, path long, value long, w double")
    seen = cut(seen.groupBy("host", "kind", "path", "value").agg(F.sum("w").alias("n")), "values")
    nodes = seen.where("kind = 0").groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s")).where("m > 1.5")
    nodes = cut(nodes, "nodes")
    look = nodes.where((F.log("m") - F.col("s") / F.col("m")) / F.log("m") < IMPORTANCE).select("host", F.lit(0).alias("kind"), F.col("path").alias("key"), F.lit(0.0).alias("h"), F.round("m").cast("long").alias("m"))
    said = seen.where("kind = 1 AND n > 1.5").join(nodes.select("host", "path", "m"), ["host", "path"])
    said = said.select("host", F.lit(1).alias("kind"), F.col("value").alias("key"), (F.log("n") / F.log("m")).alias("h"), F.round("m").cast("long").alias("m")).where(F.col("h") >= LEAST_ENTROPY)
    return look.unionByName(said)


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page in ``out``; a column of that name in ``pages`` is replaced, others pass through.

    A null or empty page has the empty text, however long pages and texts are they are read whole, and an empty table gives
    an empty table. Pages with a null url are of one unnamed host; repeated pages count once in a host's tree
    and give a row each. Text outside any element counts as text of the body. A page with ``article`` elements
    gives their text, unless it is less than a third of what is left; else that of ``main``; else all that no removed branch holds. A page
    of which the tree would leave nothing is a copy of others, and the tree removes nothing of it. Texts do not depend on ties or on the order of rows.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = cut(style_tree(pages.select(host.alias("host"), page.alias("html"))), "tree")
    n_host, n_out, n_tree = free(pages, "host", "text", "tree")
    got = pages.withColumn(n_host, host)
    if rows.count() <= BROADCAST_ROWS:
        trees: dict[str, Tree] = {}
        for r in rows.toPandas().itertuples(index=False):
            trees.setdefault(r.host, Tree()).add(r.kind, r.key, r.h, r.m)
        held = pages.sparkSession.sparkContext.broadcast({k: (t.entropy, t.uniform) for k, t in trees.items()})

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            made: dict[str, Tree] = {}
            for html_, host_ in parts:
                texts = []
                for x, name in zip(html_, host_, strict=True):
                    if name not in made and name in held.value:
                        made[name] = Tree()
                        made[name].entropy, made[name].uniform = held.value[name]
                    texts.append(Page(x).text(made.get(name)))
                yield pd.Series(texts, dtype=object)

        text = F.pandas_udf(run, "string")(page, F.col(n_host))
    else:
        per_host = rows.groupBy(F.col("host").alias(n_tree + "_h")).agg(F.collect_list(F.struct("kind", "key", "h", "m")).alias(n_tree))
        got = got.join(per_host, F.col(n_host) == F.col(n_tree + "_h"), "left")

        def run_joined(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            last, tree = None, None
            for html_, host_, rows_ in parts:
                texts = []
                for x, name, own in zip(html_, host_, rows_, strict=True):
                    if name != last:
                        last, tree = name, None if own is None else Tree()
                        for r in own if own is not None else ():
                            tree.add(r["kind"], r["key"], r["h"], r["m"])
                    texts.append(Page(x).text(tree))
                yield pd.Series(texts, dtype=object)

        text = F.pandas_udf(run_joined, "string")(page, F.col(n_host), F.col(n_tree))
    got = got.withColumn(n_out, text)
    return got.select(*[got[f"`{c}`"] for c in pages.columns if c != out], F.col(n_out).alias(out))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
