"""Main text of web pages by wrapper induction.

Pages of a host come from one template. Every page is read into a tree of block
elements and that into a skeleton: siblings in a row that share a name are one
node, and so are plain prose elements, a `~` (flow) node. Simple tree matching merges a
host's distinct skeletons into one wrapper, and aligns every skeleton with it,
so that each text of each page has a slot.

Then all pages' texts are counted slot by slot. What keeps returning in its
slot while the rest of the page changes is template; what varies is content.
Tags, roles and class names enter as prior odds only: what a page marks as its
article or as menu, footer or advert is hard to overrule, anything else is
decided by what the host's pages show.

Nothing depends on partitioning: skeletons fold in an order and in buckets of
their own, and counts are plain aggregates, combined before they are shuffled.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, over_texts

# Element names by their place in HTML, and words by which pages name their parts.
RAW = "script style noscript template iframe svg textarea select title object audio video canvas"
AWAY = {*"nav footer aside form button dialog menu fieldset header".split()}
BLOCKS = {
    *"html head body main article section div header footer nav aside form fieldset dialog menu address blockquote "
    "center details summary dd dl dt figure figcaption h1 h2 h3 h4 h5 h6 hr li ol ul p pre table caption thead tbody "
    "tfoot tr td th button".split()
}
PROSE = {
    *"p h1 h2 h3 h4 h5 h6 hr ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure "
    "figcaption address center details summary".split()
}
VOID = {*"hr br img input meta link area base col embed source track wbr".split()}
CLOSES_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "head", "body", "button"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
ROLES_AWAY = {*"navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split()}
AD_WORDS = {*"ad ads advert adverts advertisement advertising sponsor sponsored".split()}
COMMENT_WORDS = {*"comment comments commentlist respond reply replies disqus".split()}
AWAY_WORDS = {
    *"banner promo cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "share sharing social related recommended newsletter subscribe signup login popup modal overlay footer header "
    "masthead toolbar pagination pager widget widgets skip copyright paywall".split()
}
#: Words that say where or how, and so may stand beside those above in a name.
PLACE_WORDS = {
    *"box bar slot container wrapper wrap list item items section block area link links top bottom left right main site page "
    "inner outer unit panel thread form primary secondary global".split()
}

#: Attributes with quoted values, and as they are read once quotes don't pair up.
_PAIRED, _ANY = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", r"[^>]*+"
_FORM = (
    r"<!--.*?(?:-->|$)|<![^>]*+>|<\?[^>]*+>"
    rf"|<(?P<raw>{'|'.join(RAW.split())})\b(?:ATTRS)>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>ATTRS)>"
)
TOKEN, LOOSE_TOKEN = (re.compile(_FORM.replace("ATTRS", a), re.S | re.I) for a in (_PAIRED, _ANY))
TAG_START = re.compile(r"</?[a-z]", re.I)
ATTR = re.compile(r"([a-z][a-z0-9:-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|\b(hidden)\b", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
DIGITS = re.compile(r"\d+")

#: Levels and children of a node that a skeleton tells apart; beyond, nodes share their parent's or a like sibling's slot.
MOST_LEVELS, MOST_KINDS = 40, 48
#: Prior log odds of template.
SAID, NAMED, FLOW = 6.0, 4.0, 0.5
#: A text returns in a slot if so many pages have it there, and one in so many.
LEAST_PAGES, ONE_IN = 3, 128
#: Distinct pages from which on a constant text outweighs any mark.
CONSTANT_PAGES = 24
#: Skeletons that one task folds, and bytes of wrappers that are broadcast; beyond, pages are joined with them.
FAN_IN, BROADCAST_BYTES = 256, 16 << 20


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


# -- pages --------------------------------------------------------------------


def _tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Beginning, end and match of each piece of markup. Where quotes don't pair up, tags end at the next '>' from there on."""
    at, pattern = page.find("<"), TOKEN
    while at >= 0:
        m = pattern.match(page, at)
        if m is None and pattern is TOKEN and TAG_START.match(page, at):
            pattern = LOOSE_TOKEN
            m = pattern.match(page, at)
        if m:
            yield at, m.end(), m
            at = page.find("<", m.end())
        else:
            at = page.find("<", at + 1)


def _element(tag: str, attrs: str) -> str | None:
    """An element's key, its tag and names; roles stand for tags. None if it is hidden."""
    names: list[str] = []
    if attrs and not attrs.isspace():
        for name, a, b, c, bare in ATTR.findall(attrs):
            name, value = (name or bare).lower(), (a or b or c).lower()
            if name in ("class", "id"):
                names += value.split()
            elif name == "role" and value in ("main", "article"):
                tag = value
            elif name == "role" and value in ROLES_AWAY:
                tag = "nav"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and INVISIBLE.search(value):
                return None
    if not names:
        return "~" if tag in PROSE else tag
    return f"{tag}.{'.'.join(sorted({DIGITS.sub('#', n.replace('.', ''))[:40] for n in names})[:6])}"


class Page:
    """Nodes in page order (parent, key) and blocks (node, text), lenient as browsers are: unclosed and stray tags are mended."""

    def __init__(self, page: str):
        self.parent, self.key, self.blocks = [-1], ["html"], []
        stack, tags, dark = [0], ["html"], 0  # dark: levels inside a hidden element
        held: list[str] = []
        at = 0

        def flush() -> None:
            if held:
                if not dark and (text := squeeze("".join(held))):
                    self.blocks.append((stack[-1], text))
                held.clear()

        def close(i: int) -> None:
            nonlocal dark
            flush()
            dark -= sum(1 for n in stack[i:] if n < 0)
            del stack[i:], tags[i:]

        for begin, end, m in _tokens(page):
            if begin > at:
                held.append(page[at:begin])
            at = end
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in BLOCKS:
                if tag in VOID:
                    held.append(" ")
                continue
            if m["end"]:
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] == tag:
                        close(i)
                        break
                continue
            if tag in ("html", "body") and len(stack) == 1:
                continue
            if tag in CLOSES_P and tags[-1] == "p":
                close(len(tags) - 1)
            while tags[-1] in SIBLINGS.get(tag, ()):
                close(len(tags) - 1)
            flush()
            if tag in VOID:
                continue
            key = None if tag == "head" else _element(tag, m["attrs"])
            tags.append(tag)
            if key is None or dark:
                dark += 1
                stack.append(-1)
            else:
                self.parent.append(stack[-1])
                self.key.append(key)
                stack.append(len(self.key) - 1)
        if at < len(page):
            held.append(page[at:])
        flush()

    def skeleton(self) -> tuple[str, list[int]]:
        """One line `level key` per skeleton node, and for each block the line it belongs to."""
        n = len(self.key)
        own, live = [False] * n, [False] * n
        for node, _ in self.blocks:
            own[node] = live[node] = True
        inner: list[dict] = [{} for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if live[i]:
                live[self.parent[i]] = True
        for i in range(1, n):
            if live[i]:
                inner[self.parent[i]][self.key[i]] = None
        shape = [(own[i], *list(inner[i])[:8]) for i in range(n)]
        group, level, name, kids, like = [0] * n, [0], ["html"], [[]], [shape[0]]
        for i in range(1, n):
            if not live[i]:
                continue
            up = group[self.parent[i]]
            key = self.key[i]
            if level[up] >= MOST_LEVELS or key == "~" == name[up]:
                group[i] = up
                continue
            beside = kids[up]
            last = beside[-1] if beside else -1
            # nameless containers stay apart: they are the page's parts
            if beside and name[last] == key and (key == "~" or "." in key or like[last] == shape[i] == (True,)):
                group[i] = last
                continue
            if len(beside) >= MOST_KINDS:
                tag = key.partition(".")[0]
                near = [g for g in beside if name[g] == key] or [g for g in beside if name[g].partition(".")[0] == tag] or beside
                group[i] = near[-1]
                continue
            group[i] = len(name)
            beside.append(len(name))
            level.append(level[up] + 1)
            name.append(key)
            kids.append([])
            like.append(shape[i])
        line, lines, todo = [0] * len(name), [], [0]
        while todo:
            g = todo.pop()
            line[g] = len(lines)
            lines.append(f"{level[g]} {name[g]}")
            todo += reversed(kids[g])
        return "\n".join(lines), [line[group[node]] for node, _ in self.blocks]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# -- priors ---------------------------------------------------------------------


def _named(key: str, words: set[str]) -> bool:
    """Whether a class or id consists of such a word, alone or beside words of place."""
    for name in key.split(".")[1:]:
        parts = [p for p in re.split(r"[-_]", name) if p and p != "#"]
        if any(p in words for p in parts) and all(p in words or p in PLACE_WORDS or p in AWAY_WORDS for p in parts):
            return True
    return False


def priors(skeleton: str) -> list[float]:
    """Prior log odds of template for each line of a skeleton.

    Inside what the page marks as article or main, blocks are content unless
    named otherwise; outside it they are not. An article or main part outlasts
    whatever wraps it, unless that is named as comments, or is a menu, footer or
    aside on a page with another.
    """
    lines = [x.split(" ", 1) for x in skeleton.split("\n")]
    level, key = [int(a) for a, _ in lines], [b for _, b in lines]
    tag = [k.partition(".")[0] for k in key]
    up, path = [-1] * len(lines), []
    for i, at in enumerate(level):
        del path[at:]
        up[i] = path[-1] if path else -1
        path.append(i)
    away, talk = [False] * len(lines), [False] * len(lines)
    for i in range(1, len(lines)):
        talk[i] = talk[up[i]] or (tag[i] not in ("body", "main") and _named(key[i], COMMENT_WORDS))
        away[i] = away[up[i]] or tag[i] in ("nav", "footer", "aside", "dialog", "menu") or (
            tag[i] not in ("body", "article", "main") and _named(key[i], AWAY_WORDS | AD_WORDS)
        )
    holds = [False] * len(lines)  # an article
    for i in range(len(lines) - 1, 0, -1):
        holds[up[i]] |= holds[i] or (tag[i] == "article" and not talk[i])
    marked = [i for i in range(len(lines)) if not talk[i] and (tag[i] == "article" or tag[i] == "main" and not holds[i])]
    mains = {i for i in marked if not away[i]} or set(marked)
    wraps = [False] * len(lines)
    for i in range(len(lines) - 1, 0, -1):
        wraps[up[i]] |= wraps[i] or i in mains
    out, inside = [0.0] * len(lines), [False] * len(lines)
    out[0] = SAID if mains else 0.0
    for i in range(1, len(lines)):
        before, inside[i] = out[up[i]], inside[up[i]] or i in mains
        if i in mains:
            out[i] = -SAID / 2
        elif wraps[i]:
            out[i] = before
        elif talk[i] or before == SAID or tag[i] in AWAY - ({"header"} if inside[i] else set()) or _named(key[i], AD_WORDS):
            out[i] = SAID
        elif _named(key[i], AWAY_WORDS):
            out[i] = before + NAMED if inside[i] else SAID
        else:
            out[i] = before
        if key[i] == "~" and key[up[i]] != "~":
            out[i] -= SAID / 2 if inside[i] and out[i] < 0 else FLOW if out[i] < SAID else 0
    return out


# -- simple tree matching -------------------------------------------------------


def tree(skeleton: str) -> list:
    """[key, children] of a skeleton."""
    path: list[list] = []
    for line in skeleton.split("\n"):
        level, key = line.split(" ", 1)
        node = [key, []]
        del path[int(level) :]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def skeleton_of(node: list, level: int = 0) -> str:
    return "\n".join([f"{level} {node[0]}", *(skeleton_of(k, level + 1) for k in node[1])])


class Matching:
    """Simple tree matching (Yang, 1991) of two trees: the most pairs of nodes with equal keys, order and parents kept."""

    def __init__(self):
        self.tables: dict[tuple[int, int], list[list[int]]] = {}

    def size(self, a: list, b: list) -> int:
        return 0 if a[0] != b[0] else 1 + (self.table(a, b)[-1][-1] if a[1] and b[1] else 0)

    def table(self, a: list, b: list) -> list[list[int]]:
        key = (id(a), id(b))
        if key not in self.tables:
            rows = [[0] * (len(b[1]) + 1)]
            for x in a[1]:
                before, row = rows[-1], [0]
                for j, y in enumerate(b[1]):
                    row.append(max(row[-1], before[j + 1], before[j] + self.size(x, y)))
                rows.append(row)
            self.tables[key] = rows
        return self.tables[key]

    def pairs(self, a: list, b: list) -> list[tuple[list | None, list | None]]:
        """Children of both in order, paired where they match."""
        rows, i, j, out = self.table(a, b), len(a[1]), len(b[1]), []
        while i or j:
            if i and j and (w := self.size(a[1][i - 1], b[1][j - 1])) and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((a[1][i], b[1][j]))
            elif i and rows[i][j] == rows[i - 1][j]:
                i -= 1
                out.append((a[1][i], None))
            else:
                j -= 1
                out.append((None, b[1][j]))
        return out[::-1]


def merge(a: list, b: list, matching: Matching | None = None) -> list:
    """Two trees as one that holds both; roots match whatever their keys."""
    matching = matching or Matching()
    return [a[0], [x if y is None else y if x is None else merge(x, y, matching) for x, y in matching.pairs(a, b)]]


def slots(wrapper: list, skeleton: list) -> list[int]:
    """For each node of a skeleton, in order, the number of its counterpart in the wrapper, -1 for none."""
    number: dict[int, int] = {}

    def count(w: list) -> None:
        number[id(w)] = len(number)
        for k in w[1]:
            count(k)

    count(wrapper)
    matching, out = Matching(), []

    def walk(w: list | None, s: list) -> None:
        out.append(number[id(w)] if w else -1)
        partner = {id(y): x for x, y in matching.pairs(w, s) if x is not None and y is not None} if w else {}
        for y in s[1]:
            walk(partner.get(id(y)), y)

    walk(wrapper, skeleton)
    return out


# -- induction --------------------------------------------------------------------


def host(url: Column) -> Column:
    """A URL's host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def observed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, layout, skeleton, line, text, page): each text of each page, hashed.

    layout is the skeleton's hash; the skeleton itself stands in a task's first
    row of each. page tells pages apart by their three longest texts that aren't
    marked as template, so that copies of an article are evidence once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        known: dict[str, tuple[int, list[float]]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for h, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(raw.as_py())
                skeleton, at = page.skeleton()
                if skeleton not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[skeleton] = _hash(skeleton), priors(skeleton)
                layout, odds = known[skeleton]
                texts = [_hash(t) for _, t in page.blocks]
                longest = sorted(((-len(t), x) for (_, t), x, i in zip(page.blocks, texts, at) if odds[i] < SAID))[:3]
                sign = _hash(json.dumps(sorted(x for _, x in longest)))
                fresh = (h, layout) not in told
                if len(told) > 100_000:
                    told.clear()
                told.add((h, layout))
                pairs = set(zip(at, texts)) or {(0, 0)}
                rows += [(h, layout, skeleton if fresh and not k else None, i, t, sign) for k, (i, t) in enumerate(sorted(pairs))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)], names=["host", "layout", "skeleton", "line", "text", "page"]
            )

    rows = pages.where(col(html_col).isNotNull()).select(host(col(url_col)).alias("host"), col(html_col).cast("string").alias("html"))
    return over_texts(rows, run, "host string, layout long, skeleton string, line int, text long, page long")


def _folded(group: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for skeleton in sorted(group["skeleton"], key=lambda s: (-s.count("\n"), s)):
        whole = tree(skeleton) if whole is None else merge(whole, tree(skeleton))
    return pd.DataFrame({"host": group["host"].iloc[:1], "skeleton": [skeleton_of(whole)]})


def folded(skeletons: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, skeleton): each host's distinct skeletons merged, in as many rounds as their number asks for."""
    now = skeletons
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        buckets = -(-most // fan_in)
        dealt = now.withColumn("bucket", F.pmod(F.xxhash64("skeleton"), F.lit(buckets)))
        now = cut(dealt.groupBy("host", "bucket").applyInPandas(_folded, "host string, skeleton string").distinct())


def _aligned(rows: DataFrame) -> DataFrame:
    """(host, layout, slots) of (host, layout, skeleton, wrapper)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [slots(tree(w), tree(s)) for w, s in zip(batch["wrapper"], batch["skeleton"])]
            yield pd.DataFrame({"host": batch["host"], "layout": batch["layout"], "slots": found})

    return rows.mapInPandas(run, "host string, layout long, slots array<int>")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper, evidence) from all pages; null pages teach nothing.

    evidence: for each slot with a text that returns, in how many distinct pages
    the slot occurs, what share of its texts return, and the hash and share of
    pages of each that does. At least one in ONE_IN pages has such a text, so
    the list is bounded.
    """
    seen = cut(observed(pages, url_col, html_col))
    layouts = cut(seen.where(F.col("skeleton").isNotNull()).groupBy("host", "layout").agg(F.min("skeleton").alias("skeleton")))
    wrappers = cut(folded(layouts.select("host", "skeleton"), fan_in)).withColumnRenamed("skeleton", "wrapper")
    aligned = cut(_aligned(layouts.join(wrappers, "host")))
    placed = cut(
        seen.join(aligned, ["host", "layout"])
        .select("host", F.element_at("slots", F.col("line") + 1).alias("slot"), "text", "page")
        .where("slot >= 0")
        .distinct()
    )
    counts = cut(placed.groupBy("host", "slot", "text").agg(F.count("*").alias("c")))
    n = placed.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("n"))
    every = counts.groupBy("host", "slot").agg(F.sum("c").alias("all"))
    often = (
        counts.where(F.col("c") >= LEAST_PAGES).join(n, ["host", "slot"]).where(F.col("c") * ONE_IN >= F.col("n"))
        .groupBy("host", "slot", "n")
        .agg(F.sum("c").alias("again"), F.sort_array(F.collect_list(F.struct("text", (F.col("c") / F.col("n")).alias("share")))).alias("texts"))
        .join(every, ["host", "slot"])
        .select("host", F.struct("slot", "n", (F.col("again") / F.col("all")).alias("returning"), "texts").alias("e"))
        .groupBy("host").agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    )
    # a slot without a returning text is varying, however many pages it has
    sizes = cut(n).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("sizes"))
    return wrappers.join(sizes, "host", "left").join(often, "host", "left").select(
        "host", F.to_json(F.struct("wrapper", "sizes", "evidence")).alias("wrapper")
    )


class Wrapper:
    """A host's wrapper, opened: judges the texts of a page."""

    def __init__(self, packed: str | None):
        held = json.loads(packed) if packed else {}
        self.tree = tree(held["wrapper"]) if held else None
        self.pages = {x["slot"]: x["n"] for x in held.get("sizes") or []}
        self.often = {
            e["slot"]: (e["returning"], {x["text"]: x["share"] for x in e["texts"]}) for e in held.get("evidence") or []
        }
        self.known: dict[str, tuple[list[float], list[int]]] = {}

    def layout(self, skeleton: str) -> tuple[list[float], list[int]]:
        if skeleton not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            at = slots(self.tree, tree(skeleton)) if self.tree else [-1] * (skeleton.count("\n") + 1)
            self.known[skeleton] = priors(skeleton), at
        return self.known[skeleton]

    def evidence(self, slot: int, text: str) -> float:
        """Log odds of template that the host's pages give: more of them weigh more. A text on half of them is as good as constant.

        A constant text of CONSTANT_PAGES distinct pages or more weighs twice, so
        that a notice goes even where the page marks all about it as its article.
        """
        weight = min(5.0, log2(self.pages.get(slot, 1)) - 1) if self.pages.get(slot, 0) > 2 else 0.0
        if not weight:
            return 0.0
        returning, texts = self.often.get(slot, (0.0, {}))
        share = texts.get(_hash(text))
        if share is not None and share >= 0.5 and self.pages[slot] >= CONSTANT_PAGES:
            return 2 * weight
        return -weight if share is None else weight * (2 * max(min(1.0, 2 * share), returning) - 1)


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The blocks of the page's content, one a line; by prior odds alone without a wrapper."""
    if not page:
        return ""
    wrapper = wrapper or Wrapper(None)
    read = Page(page)
    skeleton, at = read.skeleton()
    odds, places = wrapper.layout(skeleton)
    return "\n".join(t for (_, t), i in zip(read.blocks, at) if odds[i] < SAID and odds[i] + wrapper.evidence(places[i], t) <= 0)


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    fan_in: int = FAN_IN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page.

    Null, empty and blank pages have an empty text. Pages without a URL or host
    share the wrapper of the empty host. Repeated pages are extracted each but
    are evidence once. No rows in: no rows out. Other columns never matter.

    Wrappers are sent to all executors if they have at most broadcast_bytes
    together; otherwise pages are joined with them.
    """
    wrappers = cut(induce(pages, url_col, html_col, fan_in))
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"),
        col(url_col).cast("string").alias("url"),
        col(html_col).cast("string").alias("html"),
        host(col(url_col)).alias("host"),
    )
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    sent = None
    if size <= broadcast_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        rows = rows.join(wrappers.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str | None, Wrapper]] = {}
        for batch in batches:
            texts = []
            for h, page, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                packed = own.as_py() if sent is None else sent.value.get(h)
                if h not in known or known[h][0] != packed:
                    if len(known) > 200:
                        known.clear()
                    known[h] = packed, Wrapper(packed)
                texts.append(main_text(page.as_py(), known[h][1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    read_rows = over_texts(rows.select("page_id", "url", "host", "html", "wrapper"), read, "page_id long, url string, text string")
    return read_rows.withColumn("n_chars", F.length("text").cast("long"))
