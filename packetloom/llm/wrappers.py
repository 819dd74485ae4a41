"""HTML extraction with wrappers: a union-free regular expression per host.

A page becomes a tree of block elements with text slots. Siblings that repeat (one after the other, or
in a pattern of a few) are folded into a repeated group; two pages of a host are aligned level by
level: what only one of them has becomes optional, texts that differ become slots, texts that stay the
same are template. Wrappers merge associatively, so tasks fold their pages first and Spark merges the
partial wrappers of a host, in two steps, however many pages the host has. The wrapper names the
region that holds the article; each page is then read through its host's region.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import only
from packetloom.session import materialise

# Element names of HTML by role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style title textarea template iframe noscript svg math object audio video canvas select".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay comment comments "
    "respond reply replies disqus share sharing social related recommended widget pagination pager toolbar search copyright legal disclaimer".split())
CLOSES = {  # an opening tag ends these open elements, up to the given ancestors
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TAG = re.compile(r"<(?:!--|([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*+)?((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>)")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")
SAME_PAGES = 5  # a text seen on so many pages of a host, and on no page another in its place, is template
DEEPER = 0.6
DEEPEST = 120  # elements nested deeper add their texts to the one at this depth


@lru_cache(10_000)
def _described(name: str, attributes: str) -> tuple[str, bool]:
    """Label of an element and whether it is boilerplate."""
    words, dropped = [], name in BOILERPLATE
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                dropped = dropped or value in ROLES
                name = "main" if value == "main" else name
            elif key == "hidden":
                dropped = True
            elif key == "style":
                dropped = dropped or "display:none" in value.replace(" ", "")
            else:
                words += [w for w in SPLIT.split(value) if w]
    dropped = dropped or not WORDS.isdisjoint(words)
    return (f"{name}.{words[0]}" if words else name), dropped


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text' | 'open' | 'close', name or text, attributes) of a page, opaque elements left out."""
    at, low = 0, None
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        m = TAG.match(page, start) or LOOSE.match(page, start)
        if m is None:  # a bare "<" is text
            yield "text", page[at:start + 1], ""
            at = start + 1
            continue
        if start > at:
            yield "text", page[at:start], ""
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        at = m.end()
        if not m[2] or m[1] in ("!", "?"):
            continue
        name = m[2].lower()
        if m[1] == "/":
            yield "close", name, ""
        elif name in OPAQUE:
            if not m[3].endswith("/"):
                low = page.lower() if low is None else low
                low = low if len(low) == len(page) else page
                end = low.find(f"</{name}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else (len(page) if name in ("script", "style") else at)
            yield "open", "br", ""
        else:
            yield "open", name, m[3]
            if m[3].endswith("/") and name not in VOID:
                yield "close", name, ""
    if at < len(page):
        yield "text", page[at:], ""


def parse(page: str) -> list:
    """Tree of block elements: [label, dropped, children]; a text block is a plain string."""
    root = ["#page", False, []]
    stack, names, text = [root], ["#page"], []

    def flush() -> None:
        if text:
            whole = "".join(text)
            block = " ".join((entities.unescape(whole) if "&" in whole else whole).split())
            text.clear()
            if block:
                stack[-1][2].append(block)

    def close(name: str, until: frozenset | set = frozenset()) -> None:
        for i in range(len(names) - 1, 0, -1):
            if names[i] == name:
                del stack[i:], names[i:]
                return
            if names[i] in until:
                return

    for kind, name, attributes in events(page):
        if kind == "text":
            text.append(name)
        elif name in INLINE:
            if name == "br":
                text.append(" ")
        elif kind == "close":
            flush()
            close(name)
        else:
            flush()
            if names[-1] == "p":
                close("p")
            ended, until = CLOSES.get(name, ((), ()))
            for other in ended:
                close(other, until)
            if name in VOID or name in ("html", "body"):
                continue
            label, dropped = _described(name, attributes)
            if "header" in label and "article" not in names and "main" not in names:
                dropped = dropped or "header" in SPLIT.split(label)
            node = [label, dropped, []]
            if len(stack) >= DEEPEST:
                continue
            stack[-1][2].append(node)
            stack.append(node)
            names.append("main" if label.startswith("main") else name)
    flush()
    return root


# --- wrappers: [label, quantifier, children]; a slot is ["#", quantifier, [text hash or null, characters, pages]]

def generalise(node) -> list:
    """A wrapper that matches exactly this part of a page, repeats folded."""
    if isinstance(node, str):
        return ["#", "", [crc32(node.encode()), len(node), 1]]
    return [node[0] + ("!" if node[1] else ""), "", fold([generalise(c) for c in node[2]])]


def _loose(a: str, b: str) -> str:
    """The quantifier that covers both: repeated and optional add up to '*'."""
    both = {*a.replace("*", "+?"), *b.replace("*", "+?")}
    return "*" if len(both) == 2 else both.pop() if both else ""


def fold(items: list) -> list:
    """Fold tandem repeats of up to four siblings into repeated groups."""
    for period in (1, 2, 3, 4):
        out: list = []
        i = 0
        while i < len(items):
            unit = items[i:i + period]
            j, times = i + period, 1
            while len(unit) == period and [x[0] for x in items[j:j + period]] == [x[0] for x in unit]:
                unit = [merge(a, b, same_page=True) for a, b in zip(unit, items[j:j + period])]
                j, times = j + period, times + 1
            if times > 1:
                out += [[x[0], _loose(x[1], "+"), x[2]] for x in unit]
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The smallest wrapper that matches what either of two wrappers with one label matches."""
    kind = _loose(a[1], b[1])
    if a[0] == "#":
        (h1, n1, p1), (h2, n2, p2) = a[2], b[2]
        return ["#", kind, [h1 if h1 == h2 else None, n1 + n2, max(p1, p2) if same_page else p1 + p2]]
    return [a[0], kind, align(a[2], b[2], same_page)]


def align(a: list, b: list, same_page: bool = False) -> list:
    """Align two sibling lists by their longest common label sequence; the rest becomes optional."""
    names_a, names_b = [x[0] for x in a], [x[0] for x in b]
    if names_a == names_b:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if names_a[i] == names_b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and names_a[i] == names_b[j]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], _loose(a[i][1], "?"), a[i][2]])
            i += 1
        else:
            out.append([b[j][0], _loose(b[j][1], "?"), b[j][2]])
            j += 1
    return fold(out)


def expression(node: list) -> str:
    """The wrapper as text, for people to read."""
    if node[0] == "#":
        return ("#" if node[2][0] is None else "'text'") + node[1]
    inner = " ".join(expression(c) for c in node[2])
    return f"({node[0]} {inner}){node[1]}" if inner else node[0] + node[1]


def _chars(node: list) -> int:
    if node[0].endswith("!"):
        return 0
    if node[0] == "#":
        return 0 if node[2][0] is not None and node[2][2] >= SAME_PAGES else node[2][1]
    return sum(_chars(c) for c in node[2])


def _named(node: list, name: str, path: tuple = ()) -> Iterator[tuple[int, tuple]]:
    for child in node[2]:
        if child[0] == "#" or child[0].endswith("!"):
            continue
        here = (*path, child[0])
        if child[0].split(".")[0] == name:
            yield _chars(child), here
        else:
            yield from _named(child, name, here)


def region(wrapper: list) -> dict:
    """Path of the element that holds the article, and the template texts to leave out of it.

    An article element wins, then a main element; without either, the walk goes down from the page
    as long as one child holds most of the characters that change from page to page.
    """
    for name in ("article", "main"):
        found = [x for x in _named(wrapper, name) if x[0]]
        if found:
            return {"path": list(max(found)[1]), "template": []}
    path, node = [], wrapper
    while True:
        total = _chars(node)
        inner = [c for c in node[2] if c[0] != "#" and c[1] not in ("+", "*") and total and _chars(c) >= DEEPER * total]
        if not inner or inner[0][0].split(".")[0] in ("p", "h1", "h2", "h3", "li", "td"):
            break
        node = inner[0]
        path.append(node[0])

    def template(x: list) -> Iterator[int]:
        if x[0] == "#":
            if x[2][0] is not None and x[2][2] >= SAME_PAGES:
                yield x[2][0]
        else:
            for c in x[2]:
                yield from template(c)

    return {"path": path, "template": sorted(set(template(node)))}


def _blocks(node: list, template: frozenset) -> Iterator[str]:
    for child in node[2]:
        if isinstance(child, str):
            if not template or crc32(child.encode()) not in template:
                yield child
        elif not child[1]:
            yield from _blocks(child, template)


def _matching(node: list, path: list) -> Iterator[list]:
    if not path:
        yield node
        return
    for child in node[2]:
        if not isinstance(child, str) and not child[1] and child[0] == path[0]:
            yield from _matching(child, path[1:])


def extract(page: str, where: dict | None) -> str:
    """Main text of a page through its host's region; a page that lacks it is its own wrapper."""
    tree = parse(page)
    found = list(_matching(tree, where["path"])) if where else []
    if not found:
        where = region(generalise(tree))
        found = list(_matching(tree, where["path"]))
    template = frozenset(where["template"])
    return "\n".join(b for node in found for b in _blocks(node, template))


# --- Spark ---------------------------------------------------------------------------------------

def host_wrappers(pages: DataFrame, salts: int = 64, held_hosts: int = 2_000) -> DataFrame:
    """(host, wrapper) from (host, html): folded within tasks, then merged by (host, salt) and host."""
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([json.dumps(w) for w in held.values()])], ["host", "wrapper"])

        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column("host"), batch.column("html")):
                host, new = host.as_py(), generalise(parse(page.as_py() or ""))
                held[host] = merge(held[host], new) if host in held else new
            if len(held) > held_hosts:
                yield out()
                held = {}
        if held:
            yield out()

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        wrapper = None
        for text in group.column("wrapper"):
            new = json.loads(text.as_py())
            wrapper = new if wrapper is None else merge(wrapper, new)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": [json.dumps(wrapper)]})

    partial = pages.mapInArrow(folded, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    some = partial.groupBy("host", "salt").applyInArrow(merged, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(merged, "host string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text; pages whose url is null or has no host share the empty
    host. Blocks stand in page order, one per line, white space inside a block is one space. Repeated
    rows give the same text each, extra columns are ignored, an empty table gives no rows. Reader
    comments, notices and the like are known by element, role, class or id.
    """
    pages = only(pages, "page_id", "url", "html").withColumn("host", F.coalesce(
        F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("")))
    wrappers = host_wrappers(pages.select("host", "html"))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([json.dumps(region(json.loads(w.as_py()))) for w in batch.column("wrapper")], pa.string())], ["host", "region"])

    regions = materialise(wrappers.mapInArrow(located, "host string, region string"), "page-regions")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for where, page in zip(batch.column("region"), batch.column("html")):
                where = where.as_py()
                if where is not None and where not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[where] = json.loads(where)
                texts.append(extract(page.as_py() or "", known.get(where)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.join(regions, "host", "left").select("page_id", "url", "html", "region").mapInArrow(
        read, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
