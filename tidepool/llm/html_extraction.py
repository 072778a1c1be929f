"""Main text of web pages: page structure plus a suffix array over each host's token streams.

1. Every page is cut into blocks in page order. Scripts, styles, markup and comments vanish,
   character references are decoded, white space inside a block becomes one space.
2. A block inside ``article`` / ``main`` is *protected*: what some articles repeat (a copied article, a
   licence line) is content. A block inside an element that names itself a menu, header, footer,
   sidebar, notice, advert, form or comment section is *chrome* and never text of the page. Headings, paragraphs, tables, figures and
   quotations are not judged by their id (an anchor), and a longer name counts only if all its words are such words or plain ones.
   All other blocks are *open*.
3. The chrome and open blocks of a host's pages, joined in page order, are its token streams.
   Their suffixes, one from every token on, are dealt by host
   and leading ``RUN`` tokens, which brings together the neighbours of the host's suffix array
   that share ``RUN`` tokens; a neighbourhood reached by two distinct pages is a repeated substring.
   Longer repeats are unions of overlapping neighbourhoods, so their length has no bound and their
   place in a block does not matter. Of a block, a repeat takes the whole, ``RUN`` tokens or more at
   either end, or ``2 * RUN`` or more inside; what is shorter is a common phrase or spills over from a neighbour.
4. A page with protected blocks is the text of those, less what nearly all articles of the host repeat:
   substrings in ``SHARE`` of its distinct articles and ``MANY`` at least. They are counted at block ends and
   at winnowed positions, which find every run of ``2 * RUN`` tokens, and a second time at all positions near those found.
5. For any other page the tokens that repeated substrings cover are removed from its open blocks and the unique
   runs stay. If nothing would stay (a page that occurs as a whole at several addresses, an article of
   template text only), the blocks stay. Unique runs of open blocks that outweigh the protected blocks of
   their page (a teaser beside the text) stay as well.

Only pages that need it meet the repeated substrings, and then only as (suffix key, position);
the suffixes of a hot host are spread by their leading tokens, and a hot run collapses in the
map-side combine to one row of each task, so no host is ever held by one task.

Defined results: null or empty html, and html without main text, give an empty text; a null or
unparsable url is the host "". Exact copies of a page count as one page for repeats. Repeated
rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens that two pages must share in sequence for a repeat.
RUN = 6
#: A run of the protected blocks is template text if so large a part of the host's distinct articles has it, and so many.
SHARE, MANY = 0.75, 4

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name up to its end; a quoted value may hold ``>``.
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
#: Elements whose content is no markup, up to their end tag or the end of the page.
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
#: Elements with markup of their own that is not text of the page; of the second kind, a block element ends them, as it does when a page is shown.
_APART, _FOREIGN = {"template", "object", "canvas", "audio", "video", "svg", "math", "select"}, {"svg", "math", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CHROME_TAG = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words by which an element names itself in a class or id: a name is one of these alone, or with others of them and of the plain words below ("comment-list", not "related-work").
_CHROME_WORD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "respond", "disqus",
                "cookie", "cookies", "consent", "gdpr", "footer", "foot", "form", "header", "masthead", "menu", "menus", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
                "notification", "pagination", "pager", "popup", "modal", "promo", "promotion", "related", "recommended", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social",
                "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
_PLAIN_WORD = {"account", "all", "area", "article", "articles", "bar", "blog", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "dropdown", "entry",
               "first", "fixed", "floating", "global", "group", "icon", "icons", "info", "inline", "inner", "item", "items", "js", "last", "latest", "left", "link", "links", "list", "login", "logo",
               "main", "media", "message", "meta", "mobile", "more", "my", "new", "news", "our", "outer", "overlay", "page", "panel", "policy", "popular", "post", "posts", "primary", "privacy",
               "reader", "readers", "recent", "right", "row", "search", "secondary", "section", "site", "slot", "sticky", "stories", "story", "strip", "sub", "tab", "tabs", "text", "thread",
               "title", "toggle", "top", "unit", "user", "users", "visitor", "web", "wp", "wrap", "wrapper", "your", "zone"}
#: Elements that hold an article's own text; a class of one chrome word alone can name them otherwise, an id never does.
_CONTENT_TAG = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "blockquote", "pre", "dl", "dt", "dd"}
_CLOSES_P = _BLOCK - {"body", "html"}
_WORD = re.compile(r"[a-z]+")
_MARK = {"open": "", "chrome": "\x00", "main": "\x01"}
_RUNS = "runs array<long>, places array<int>"


def _named(value: str, alone: bool) -> set[str]:
    """Chrome words by which an element with this class or id names itself; ``alone``: only names of one word."""
    found: set[str] = set()
    for name in value.split():
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        own = _CHROME_WORD.intersection(words)
        if own and (len(words) == 1 or not alone) and all(w in _CHROME_WORD or w in _PLAIN_WORD for w in words):
            found |= own
    return found


def _zone(tag: str, attrs: str, inside: str) -> str:
    """Zone of an element's content: chrome wins, then main, else what surrounds it."""
    if inside == "chrome":
        return inside
    if tag in _CHROME_TAG or tag in _APART or tag == "header" and inside != "main":
        return "chrome"
    if tag in ("article", "main"):
        zone = "main"
    else:
        zone = inside
    if attrs.strip(" /"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return "chrome"
            if name == "role":
                if value in _CHROME_ROLE:
                    return "chrome"
                if value in ("main", "article"):
                    zone = "main"
            elif name == "itemprop" and value == "articleBody":
                zone = "main"
            elif name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                content = tag in _CONTENT_TAG
                if not (content and name == "id") and _named(value, content) - ({"header", "masthead"} if inside == "main" else set()):
                    return "chrome"
            elif name in ("class", "id") and tag == "article" and {"comment", "comments", "ad", "advert", "promo", "related", "teaser"}.intersection(value.lower().split()):
                return "chrome"
    return zone


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag; comments and other markup have no name. One pass, whatever the page.

    A caller that skips text sends the place to go on from.
    """
    pos, quotes = 0, True
    while (i := page.find("<", pos)) >= 0:
        if page[i + 1 : i + 2] in ("!", "?"):
            mark = "-->" if page.startswith("<!--", i) else "]]>" if page.startswith("<![CDATA[", i) else ">"
            end = page.find(mark, i + (4 if mark == "-->" else 2))
            end = end + len(mark) if end >= 0 else len(page)
            pos = (yield i, end, "", "", "") or end
            continue
        m = _NAME.match(page, i)
        if not m:
            pos = i + 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            end = rest.end()
        else:  # a quote without an end, or no end at all: from here on the next > ends a tag
            quotes, end = False, page.find(">", m.end()) + 1
            if not end:
                return
        pos = (yield i, end, m[1], m[2].lower(), page[m.end() : end - 1]) or end


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's non-empty blocks in page order; zone is main, open or chrome. Time is linear in the page."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements with the zone around them
    levels: list[int] = []  # places of block elements in the stack
    n_open: Counter[str] = Counter()
    zone, run, pos = "open", [], 0
    held: list[tuple[str, list[str], int]] = []  # a block's text before an inline chrome element, and the element's depth

    def emit(kind: str, texts: list[str]) -> None:
        body = " ".join(htmllib.unescape("".join(texts)).split())
        if body:
            out.append((kind, body))

    def flush() -> None:
        for kind, texts, _ in held:
            emit(kind, texts)
        held.clear()
        emit(zone, run)
        run.clear()

    def close(i: int) -> None:
        """Ends the elements from the stack's place ``i`` on."""
        nonlocal zone
        zone = stack[i][1]
        while len(stack) > i:
            n_open[stack.pop()[0]] -= 1
        while levels and levels[-1] >= i:
            levels.pop()

    tags, skip = _tags(page), None
    while True:
        try:
            start, end, slash, tag, attrs = tags.send(skip)
        except StopIteration:
            break
        skip = None
        run.append(page[pos:start])
        pos = end
        if not tag:
            continue
        closed = attrs.endswith("/")
        if tag in _RAW and not slash:
            if not closed:
                over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = skip = over.end() if over else len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK or tag in _CHROME_TAG:
            flush()
        if slash:
            if n_open[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if held and held[-1][2] >= i:
                    emit(zone, run)
                    run[:] = held.pop()[1]
                close(i)
            continue
        if tag in _BLOCK and any(n_open[f] for f in _FOREIGN):
            close(min(i for i in range(len(stack)) if stack[i][0] in _FOREIGN))
        if tag in _CLOSES_P and levels:  # a block ends an open paragraph, and an item the item before it
            last = stack[levels[-1]][0]
            if last == "p" or last == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                close(levels[-1])
        inner = _zone(tag, attrs, zone)
        if inner != zone and tag not in _BLOCK and not closed:
            held.append((zone, run[:], len(stack)))
            run.clear()
        elif inner != zone:
            flush()
        if not closed:
            if tag in _BLOCK:
                levels.append(len(stack))
            stack.append((tag, zone))
            n_open[tag] += 1
            zone = inner
    run.append(page[pos:])
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _key(host: str, tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join([host, *tokens])) - (1 << 63)


class _Tokens(dict):
    """64-bit hashes of tokens, computed once each."""

    def __missing__(self, token: str) -> int:
        self[token] = code = xxhash.xxh64_intdigest(token)
        return code


_tokens, _MOST_TOKENS = _Tokens(), 300_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def run_keys(host: str, tokens: list[str]) -> np.ndarray:
    """64-bit keys of host and the ``RUN`` tokens from every position that has as many after it; of all tokens if there are fewer."""
    if len(_tokens) > _MOST_TOKENS:
        _tokens.clear()
    codes = np.fromiter(map(_tokens.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(RUN, len(tokens))
    n = len(tokens) - width + 1
    key = np.full(n, xxhash.xxh64_intdigest(host, width), dtype=np.uint64)
    for j in range(width):
        key = key * _M[0] + codes[j : j + n]
    key = (key ^ (key >> np.uint64(30))) * _M[1]
    key = (key ^ (key >> np.uint64(27))) * _M[2]
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def suffixes(parts: list[tuple[str, str]], host: str) -> list[int]:
    """Keys of host and the next ``RUN`` tokens, for every position of the stream that has as many after it."""
    tokens = [t for zone, body in parts if zone != "main" for t in body.split(" ")]
    return run_keys(host, tokens).tolist() if len(tokens) >= RUN else []


def article_keys(parts: list[tuple[str, str]], host: str, near: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Keys of runs inside the protected blocks and their positions: block ends and winnowed ones, or all around ``near``.

    A block of fewer than ``RUN`` tokens is a run of its own.
    """
    bodies = [body.split(" ") for zone, body in parts if zone == "main"]
    flat = [t for tokens in bodies for t in tokens]
    found = run_keys(host, flat) if len(flat) >= RUN else np.zeros(0, dtype=np.int64)  # those across two blocks are not used
    least = np.arange(max(len(found) - RUN, 0))  # the leftmost smallest of RUN + 1 keys from each on
    for j in range(1, RUN + 1):
        ahead = np.arange(j, j + len(least))
        least = np.where(found[ahead] < found[least], ahead, least)
    keys, places, at = [], [], 0
    for tokens in bodies:
        n = len(tokens) - RUN + 1
        if near is not None:
            n = max(1, n)
            picked = sorted({at + i for h in near if at <= h < at + n for i in range(max(0, h - at - RUN), min(n, h - at + RUN + 1))})
        elif n <= RUN + 1:
            picked = sorted({at, at + n - 1, at + int(found[at : at + n].argmin())}) if n > 0 else [at]
        else:
            picked = sorted({at, at + n - 1, *least[at : at + n - RUN].tolist()})
        keys += (run_keys(host, tokens) if len(tokens) < RUN else found[picked]).tolist() if picked else []
        places += picked
        at += len(tokens)
    return keys, places


def article_of(parts: list[tuple[str, str]], host: str) -> int | None:
    """What tells the distinct articles of a host apart; None without protected blocks."""
    body = [b for zone, b in parts if zone == "main"]
    return _key(host, body) if body else None


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.xxhash64(body).alias("page"))


def streams(rows: DataFrame) -> DataFrame:
    """Every page's suffixes and article keys, and for a page with open blocks all its blocks, marked by zone.

    Written to the shared folder: the repeats and the pages that need them both read it.
    """
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        opened, keys, hosts, articles, runs, at = [], [], [], [], [], []
        for address, body in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts, host = blocks(body), host_of(address)
            keys.append(suffixes(parts, host))
            opened.append([_MARK[zone] + b for zone, b in parts] if is_free(parts) else None)
            hosts.append(_key(host, []))
            articles.append(article_of(parts, host))
            found = article_keys(parts, host)
            runs.append(found[0])
            at.append(found[1])
        cols = [pa.array(opened, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(hosts, pa.int64()), pa.array(articles, pa.int64()),
                pa.array(runs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["page_id", "url", "page", "opened", "suffixes", "host", "article", "runs", "places"])

    found = common.map_arrow(rows, ["page_id", "url", "page", "html"], ", ".join([*fields, "page long", "opened array<string>", "suffixes array<long>", "host long, article long", _RUNS]), run)
    return common.reread(found, "html-streams")


def repeated(stream: DataFrame) -> DataFrame:
    """Suffix keys that two distinct pages of a host share."""
    found = stream.select("page", F.explode("suffixes").alias("suffix"))
    return found.groupBy("suffix").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo < hi").select("suffix")


def _by_place(found: DataFrame) -> DataFrame:
    return found.select("url", "page", "host", "article", F.explode(F.arrays_zip("runs", "places")).alias("r")).select("url", "page", "host", "article", F.col("r.runs").alias("run"), F.col("r.places").alias("at"))


def template_places(found: DataFrame, articles: DataFrame, name: str, kind: str) -> DataFrame:
    """url, page and the places (as ``name``) of runs that nearly all distinct articles of the host have.

    A run that at most a quarter of ``n`` articles lack is in ``n / 12`` or more of any third of them, so the largest third
    of a host of 24 or more tells the runs to count in all. The host is looked up for the few in ``MANY`` articles.
    """
    def counts(placed: DataFrame, least: int) -> DataFrame:
        return placed.select("run", "article").distinct().groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least)

    placed = _by_place(found)
    third = placed.join(articles, "host").where((F.col("n_articles") < 24) | (F.pmod("article", F.lit(3)) == F.col("third")))
    few = common.reread(counts(third, 2).select("run"), f"{kind}-few")
    counted = common.reread(counts(placed.join(few, "run"), MANY), f"{kind}-counted")
    held = placed.join(counted, "run").groupBy("run", "host").agg(F.max("n").alias("n"))
    template = common.reread(held.join(articles, "host").where(F.col("n") >= SHARE * F.col("n_articles")).select("run"), f"{kind}-runs")
    return common.reread(placed.join(template, "run").groupBy("url", "page").agg(F.collect_set("at").alias(name)), kind)  # no more than the page has tokens


def article_repeats(rows: DataFrame, stream: DataFrame) -> DataFrame:
    """url, page, ``template``: places of template runs in the protected blocks."""
    thirds = stream.where("article is not null").select("host", "article").distinct().groupBy("host", F.pmod("article", F.lit(3)).alias("third")).agg(F.count("*").alias("n"))
    articles = thirds.groupBy("host").agg(F.sum("n").alias("n_articles"), F.max_by("third", "n").alias("third")).where(F.col("n_articles") >= MANY)
    articles = common.reread(articles, "html-articles")
    near = template_places(stream, articles, "near", "html-near")
    url_type = rows.schema["url"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, own, runs, at = [], [], [], []
        for address, body, places in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts, host = blocks(body), host_of(address)
            hosts.append(_key(host, []))
            own.append(article_of(parts, host))
            found = article_keys(parts, host, places)
            runs.append(found[0])
            at.append(found[1])
        cols = [pa.array(hosts, pa.int64()), pa.array(own, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["url", "page", "host", "article", "runs", "places"])

    around = common.map_arrow(of_page(rows, near, "inner"), ["url", "page", "html", "near"], f"url {url_type}, page long, host long, article long, {_RUNS}", run)
    return template_places(common.reread(around, "html-around"), articles, "template", "html-template")


def of_page(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows with what was found for their url and page."""
    found = found.withColumnsRenamed({"url": "_url", "page": "_page"})
    return rows.join(found, F.col("page").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")), how).drop("_url", "_page")


def is_free(parts: list[tuple[str, str]]) -> bool:
    """Whether a page has open blocks."""
    return any(zone == "open" for zone, _ in parts)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, template_tokens of every row.

    ``template_tokens``: tokens of open or protected blocks removed as covered by repeated substrings (null for
    a page whose text is its whole protected blocks).
    """
    rows = _keyed(pages, page_id, url, html)
    id_type, url_type = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    stream = streams(rows)
    template = article_repeats(rows, stream)

    def protected(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, text, gone = [], [], []
        for i, (body, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            parts = blocks(body)
            if not is_free(parts):
                keep.append(i)
                left, n = article_text([b for zone, b in parts if zone == "main"], places or [])
                text.append("\n".join(b for b in left if b))
                gone.append(n or None)
        kept = batch.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(text, pa.string()), pa.array(gone, pa.int64())], names=shape)

    shape = ["page_id", "url", "text", "template_tokens"]
    fields = f"page_id {id_type}, url {url_type}, text string, template_tokens long"
    plain = common.map_arrow(of_page(rows, template, "left"), ["page_id", "url", "html", "template"], fields, protected)

    free = stream.where("opened is not null")
    hits = (
        free.select("url", "page", F.posexplode("suffixes").alias("at", "suffix"))
        .distinct()
        .join(repeated(stream), "suffix")
        .groupBy("url", "page")
        .agg(F.collect_set("at").alias("covered"))  # no more than the page has tokens
    )
    joined = of_page(of_page(free, hits, "left"), template, "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, gone = [], []
        for parts, covered, places in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            body, n = unique_runs(parts, covered or [], places or [])
            text.append(body)
            gone.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(gone, pa.int64())], names=shape)

    freed = common.map_arrow(joined, ["page_id", "url", "opened", "covered", "template"], fields, cut)
    return plain.unionByName(freed).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_tokens")


def without_repeats(tokens: list[str], at: int, hidden: set[int]) -> list[str]:
    """Tokens of a block at a position of the stream, less the hidden stretches that are long enough."""
    end, cut, start = at + len(tokens), set(), None
    for i in range(at, end + 1):
        if i < end and i in hidden:
            start = i if start is None else start
        elif start is not None:
            whole_block, edge = i - start == len(tokens), start == at or i == end
            if whole_block or i - start >= (RUN if edge else 2 * RUN):
                cut.update(range(start, i))
            start = None
    return [t for i, t in enumerate(tokens, at) if i not in cut]


def article_text(parts: list[str], places: list[int]) -> tuple[list[str], int]:
    """The protected blocks without the template runs at ``places`` (all of them if nothing would stay), and the number of tokens removed."""
    if not places:
        return parts, 0
    at, gone, out = 0, 0, []
    for part in parts:
        tokens = part.split(" ")
        end = at + len(tokens)
        left = without_repeats(tokens, at, {i for s in places if at <= s < end for i in range(s, min(end, s + RUN))})
        gone += len(tokens) - len(left)
        out.append(" ".join(left))
        at = end
    return (out, gone) if any(out) else (parts, 0)


def unique_runs(parts: list[str], covered: list[int], places: list[int] = ()) -> tuple[str, int | None]:
    """Text of a page with open blocks without the repeats at the covered positions, and the number of tokens removed."""
    hidden: set[int] = set()
    for s in covered:
        hidden.update(range(s, s + RUN))
    main, cut = article_text([p[1:] for p in parts if p.startswith("\x01")], places)
    own = iter(main)
    out, whole, at, gone, n_open, n_main = [], [], 0, 0, 0, sum(len(b.split()) for b in main)
    for part in parts:
        if part.startswith("\x01"):
            out.append(next(own))
            continue
        chrome = part.startswith("\x00")
        tokens = part.lstrip("\x00").split(" ")
        if not chrome:
            left = without_repeats(tokens, at, hidden)
            n_open += len(left)
            gone += len(tokens) - len(left)
            whole.append(" ".join(tokens))
            out.append(" ".join(left))
        at += len(tokens)
    if main and n_open <= n_main:
        return "\n".join(b for b in main if b), cut or None
    return ("\n".join(b for b in out if b), gone + cut) if n_open else ("\n".join(whole), 0)
