"""Main text of web pages by equivalence-class template deduction.

Pages of one host are filled-in copies of a template. Every token of a page, an opening
tag or a whole text node together with the path of tags above it, has an occurrence
vector: how often it stands on each page of the host. Tokens with the same vector form
an equivalence class. The class of what stands once on every page is the root. Another
class is nested in it if it is valid: on all its pages its tokens come in one order, and
each stands in the same gap between the root's tokens. Classes on nearly all pages of the
host, and those of a layout on some of them, make the template; what stands between its
tokens are slots. Text that some pages merely repeat has no tag of its own, so a class of
a layout must hold one.

A vector is kept as a fingerprint: the exclusive or of one hash for each (page, count),
with the number of pages and occurrences. It is built by partial aggregation, so a host
with a third of all pages is folded before the shuffle. Order and gaps of a class are one
hash a page, and valid where the least and the largest of them are equal.

The text of a page is its main part. Where ``article`` or ``main`` marks it, all of that is
kept but elements that are no text of it, so text that pages share stays: an introduction
that every article has is part of each. Elsewhere the template finds it: the smallest
container that holds more than half of what the slots hold, links left out; of that the
slots are kept and the template's own text nodes go, unless no text lies in a slot. Words
in class and id names decide nothing by themselves: a container that they make look like
a side element goes only where links or template texts are at least half of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, required

#: Distinct pages of a host, tokens of a class and share of the host's pages that a template takes.
MIN_PAGES, MIN_TOKENS, SHARE = 2, 3, 0.9
#: Tokens times pages of a class: what few pages lack as evidence, more tokens must give.
EVIDENCE = 24
#: Share of the slots' text that a container must exceed to be the main part of a page that marks none.
MAIN = 0.5
#: Template tokens and hosts up to which the templates go to every executor.
BROADCAST_TOKENS = 1_000_000
#: Tokens counted in a task before they are handed on.
FLUSH = 100_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("head nav footer aside form script style title textarea noscript iframe xmp template button select option dialog menu svg canvas object audio video".split())
ENDS_P = BLOCKS - {"body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "dd", "dt", "summary"}
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
OUTSIDE_NAMES = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies social share sharing related recommended popup modal overlay widget pagination pager toolbar masthead topbar skip".split())
#: Whole class names and ids of containers that hold adverts or what readers wrote.
NEVER = frozenset("ad ads advert adverts advertisement adsbygoogle sponsored comments comment-list commentlist reader-comments disqus_thread".split())
CONTAINERS = frozenset("article aside body center dd details dialog div dl fieldset figure form html main ol section table tbody td tr ul".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|$)"
    r"|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|$)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


#: How sure it is that an element is no main text: by its name or role, or only by words in its names.
INSIDE, SOFT, HARD = 0, 1, 2


def _outside(name: str, attrs: dict[str, str], in_main: bool) -> int:
    """Whether an element is part of a page's main text; inside a marked part words decide nothing."""
    role = attrs.get("role", "").lower()
    if name in OUTSIDE or role in OUTSIDE_ROLES or (name == "header" and not in_main):
        return HARD
    if name in ("html", "body", "main", "article") or role in ("main", "article") or name not in CONTAINERS | {"header"}:
        return INSIDE
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    if not NEVER.isdisjoint(names.split()):
        return HARD
    words = set(re.split(r"[\s_-]+", names))
    return SOFT if not in_main and ("header" in words or not OUTSIDE_NAMES.isdisjoint(words)) else INSIDE


def walk(page: str):
    """Yield (kind, path, value, outside, main) of each opening tag and text node.

    kind is "tag", "end" of an element or "text"; ``value`` is the tag name or the raw
    text. Missing end tags are implied as HTML does for paragraphs, items and cells.
    """
    stack: list[tuple[str, str, int, bool]] = [("", "", INSIDE, False)]  # name, path, outside, main
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        if not m:
            break
        at = m.end()
        if m["text"] is not None:
            end = at
            while end < size and (page[end] != "<" or not _TOKEN.match(page, end)["name"] and _TOKEN.match(page, end)["text"]):
                end = _TOKEN.match(page, end).end()
            yield "text", stack[-1][1], page[m.start() : end], stack[-1][2], stack[-1][3]
            at = end
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        _, path, out, main = stack.pop()
                        yield "end", path, name, out, main
                    break
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"] or m["attrs2"] or "")}
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        _, path, out, main = stack.pop()
                        yield "end", path, "p", out, main
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in ENDS_SELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS_SELF[name]:
                    while len(stack) > k:
                        closed, path, out, main = stack.pop()
                        yield "end", path, closed, out, main
                    break
                if stack[k][0] in WALLS[name]:
                    break
        _, path, out, main = stack[-1]
        marks = f"{name}.{attrs['class']}" if attrs.get("class") else name
        out = max(out, _outside(name, attrs, main))
        main = main or name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        entry = (name, f"{path}>{marks}", out, main)
        yield "tag", entry[1], name, out, main
        if name in RAW:
            close = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = close.start() if close else size
            yield "end", entry[1], name, out, main
        elif name not in VOID:
            stack.append(entry)


def _key(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{' '.join(text.split())}".encode("utf-8", "surrogatepass")) - (1 << 63)


def page_tokens(page: str) -> tuple[Counter, set[int]]:
    """Occurrences of each token of a page, and which are tags; blank text nodes are none."""
    found, tags = Counter(), set()
    for kind, path, value, _, _ in walk(page):
        if kind == "tag":
            tags.add(key := _key(path))
            found[key] += 1
        elif kind == "text" and value.strip():
            found[_key(path, value)] += 1
    return found, tags


def _elements(nodes: list) -> list[tuple[int, int]]:
    """Nodes from and to of every element, inner ones first."""
    spans, open_ = [], []
    for k, (kind, _, value, _, _) in enumerate(nodes):
        if kind == "tag" and value not in VOID:
            open_.append(k)
        elif kind == "end" and open_:
            spans.append((open_.pop(), k + 1))
    return spans + [(k, len(nodes)) for k in reversed(open_)]


def _weights(nodes: list, counts) -> list[int]:
    """Characters of the text nodes that count, summed from the start up to each node."""
    before = [0]
    for k, node in enumerate(nodes):
        before.append(before[-1] + (len(node[2].strip()) if node[0] == "text" and counts(k, node) else 0))
    return before


def _linked(nodes: list) -> list[bool]:
    """Whether each node lies in a link."""
    return [">a>" in f"{path}>" or ">a." in path for _, path, _, _, _ in nodes]


def _main_part(nodes: list, template: frozenset[int]) -> list:
    """Nodes of the smallest container with more than ``MAIN`` of the slots' text, without side elements."""
    linked = _linked(nodes)
    slot = lambda node: _key(node[1], node[2]) not in template
    prose = _weights(nodes, lambda k, node: node[3] < HARD and not linked[k] and slot(node))
    text = _weights(nodes, lambda k, node: node[3] < HARD)
    held = prose if prose[-1] else text
    spans = _elements(nodes)
    fitting = [(b - a, a, b) for a, b in spans if nodes[a][2] in CONTAINERS and held[b] - held[a] > MAIN * held[-1]]
    first, last = min(fitting)[1:] if held[-1] and fitting else (0, len(nodes))
    gone = [False] * len(nodes)
    for a, b in spans:
        side = nodes[a][3] == SOFT and first < a and b <= last
        if side and 2 * (prose[b] - prose[a]) <= text[b] - text[a]:
            gone[a:b] = [True] * (b - a)
    return [node for k, node in enumerate(nodes[first:last], first) if not gone[k]]


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the main part joined by an empty line.

    A marked main part is kept whole. Of a page that marks none the slots of the part are
    kept where the template finds one; without a template, or without text in slots, all
    that is not outside.
    """
    nodes = list(walk(page))
    inside = any(main and out < HARD for _, _, _, out, main in nodes)
    blocks, parts = [], []
    if inside or not any(kind == "text" and out < HARD and value.strip() and _key(path, value) not in template for kind, path, value, out, _ in nodes):
        template = frozenset()
    if not inside:
        nodes = _main_part(nodes, template)

    def close():
        block = " ".join(html.unescape("".join(parts)).split())
        if block:
            blocks.append(block)
        parts.clear()

    for kind, path, value, out, main in nodes:
        if kind != "text":
            if value in BLOCKS:
                close()
            elif value == "br":
                parts.append(" ")
        elif out < HARD and (main or not inside) and not (template and _key(path, value) in template):
            parts.append(value)
    close()
    return "\n\n".join(blocks)


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def distinct_pages(rows: DataFrame) -> DataFrame:
    """``rows(host, ident, html)`` with each html once a host.

    Only rows that have a copy are gathered, and those are folded before the shuffle.
    """
    keyed = rows.select("host", "ident", "html", F.xxhash64("html").alias("own"))
    copied = keyed.groupBy("host", "own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "own")
    copied = materialize(copied, "copied")
    single = keyed.join(copied, ["host", "own"], "left_anti").select("host", "ident", "html")
    first = keyed.join(copied, ["host", "own"], "left_semi").groupBy("host", "own").agg(F.min("ident").alias("ident"), F.first("html").alias("html"))
    return single.unionByName(first.select("host", "ident", "html"))


def candidates(pages: DataFrame, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS, share: float = SHARE) -> DataFrame:
    """(host, classes array<struct<token,class>>): tokens of classes with evidence; class 0 is the root."""

    def count(batches):
        seen: dict[tuple[str, int], list[int]] = {}

        def flush():
            rows = [(h, t, *v) for (h, t), v in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(6)], ["host", "token", "vector", "pages", "times", "tag"])

        for batch in batches:
            for host, ident, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, tags = page_tokens(page)
                tokens[0] = 1  # the page as a whole
                marks: dict[int, int] = {}
                for token, times in tokens.items():
                    mark = marks.get(times)
                    if mark is None:
                        mark = marks[times] = xxhash.xxh64_intdigest(f"{ident}:{times}") - (1 << 63)
                    entry = seen.get((host, token))
                    if entry is None:
                        seen[host, token] = [mark, 1, times, int(token in tags)]
                    else:
                        entry[0] ^= mark
                        entry[1] += 1
                        entry[2] += times
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    vectors = pages.select("host", "ident", "html").mapInArrow(count, "host string, token long, vector long, pages long, times long, tag long")
    tokens = vectors.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.max("tag").alias("tag"))
    frequent = materialize(tokens.where(F.col("pages") >= min_pages), "tokens")
    key = ["host", "vector", "pages", "times"]
    roots = frequent.where("token = 0").select("host", F.col("pages").alias("of"), F.col("vector").alias("root"))
    classes = frequent.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max("tag").alias("tag")).join(roots, "host")
    is_root = (F.col("vector") == F.col("root")) & (F.col("pages") == F.col("of")) & (F.col("times") == F.col("of"))
    enough = (F.col("size") >= min_tokens) & (F.col("size") * F.col("pages") >= EVIDENCE)
    # The root takes part in any case, as what the others are nested in.
    kept = classes.where(is_root | enough & ((F.col("pages") >= F.col("of") * share) | (F.col("tag") > 0)))
    name = F.when(is_root, 0).otherwise(F.xxhash64("vector", "pages", "times")).alias("class")
    named = kept.select(*key, name, enough.alias("enough"))
    return frequent.where("token <> 0").join(named, key).groupBy("host").agg(F.collect_list(F.struct("token", "class", "enough")).alias("classes"))


def templates(pages: DataFrame, found: DataFrame, broadcast_tokens: int) -> DataFrame:
    """(host, template array<long>): tokens of the valid classes of ``found``."""

    def order(batches):
        for batch in batches:
            out: dict[tuple[str, int], list[int]] = {}
            for host, page, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {c["token"]: c["class"] for c in classes or ()}
                gap, runs = 0, {}
                for kind, path, value, _, _ in walk(page) if own else ():
                    if kind == "tag" or kind == "text" and value.strip():
                        token = _key(path, value if kind == "text" else "")
                        name = own.get(token)
                        if name is not None:
                            gap += name == 0
                            runs.setdefault(name, xxhash.xxh64()).update(f"{token}:{gap};")
                for name, run in runs.items():
                    seen = run.intdigest() - (1 << 63)
                    held = out.setdefault((host, name), [seen, seen])
                    held[:] = min(held[0], seen), max(held[1], seen)
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *[pa.array(x, pa.int64()) for x in ([k[1] for k in keys], [out[k][0] for k in keys], [out[k][1] for k in keys])]], ["host", "class", "low", "high"])

    orders = _with_template(pages.select("host", "html"), found, broadcast_tokens, "classes").select("host", "html", "classes").mapInArrow(order, "host string, class long, low long, high long")
    valid = orders.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select("host", "class")
    tokens = found.select("host", F.explode("classes").alias("c")).select("host", "c.*").where("enough")
    return tokens.join(valid, ["host", "class"]).groupBy("host").agg(F.collect_set("token").alias("template"))


def _with_template(rows: DataFrame, held: DataFrame, broadcast_tokens: int, column: str = "template") -> DataFrame:
    """Pages with the template of their host; ``held`` is a written table.

    Templates of a measured size at most ``broadcast_tokens`` go to the pages, which then
    stay where they are. Larger ones meet the pages in an equi-join by host, whose hot
    hosts adaptive execution can split.
    """
    size = held.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0]
    return rows.join(F.broadcast(held) if size <= broadcast_tokens else held.hint("merge"), "host", "left")


def extract(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    Null html is empty and has the empty text; so has a page without main text. A null or
    malformed url belongs to the host "" and is returned as it is. Rows that repeat, and
    pages with the same content, are each extracted whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = required(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    rows = rows.withColumn("ident", F.xxhash64("page_id", "url", "html"))
    pages_ = distinct_pages(rows)
    classes = materialize(candidates(pages_), "classes")
    found = materialize(templates(pages_, classes, broadcast_tokens), "templates")

    def run(batches):
        for batch in batches:
            ids, urls, html_, marks = batch.columns
            held: dict[int, frozenset[int]] = {}
            out = []
            for page, template in zip(html_, marks, strict=True):
                values = tuple(template.as_py() or ())
                key = hash(values)
                if key not in held:
                    held[key] = frozenset(values)
                out.append(main_text(page.as_py(), held[key]))
            counts = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    joined = _with_template(rows, found, broadcast_tokens).select("page_id", "url", "html", "template")
    types = dict(rows.dtypes)
    return joined.mapInArrow(run, f"page_id {types['page_id']}, url string, text string, n_chars long")
