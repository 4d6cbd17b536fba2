"""Main text of web pages by union-free regular expressions inferred per host.

A page is a stream of block tags and text. Streams of one host are aligned one after the other:
equal tags are matched (longest common subsequence of siblings, level by level), neighbours with one
tag become a repeated group, runs of tags that come again become a repeated group of several, what
only one side has becomes optional, and text becomes a slot. A slot is known by the tags, classes, ids and
roles it stands in, at any depth. What a host's wrapper tells of its slots decides which texts are the page's own:

* a text that a slot has on all pages with that slot is the template's, if two different pages at least
  show it, and in article or main elements FIRM of them, as revisions of a page share most of their text;
* a slot of a repeated group whose texts all are links, on two different pages at least, is a menu;
* slots in what HTML or its marks name as menus, headers, footers, sidebars, notices, adverts, forms or
  comments are not main text; where a page has text of its own in article or main elements, that is
  its main text, and otherwise all other slots are.

Pages of one text count as one. A class or id is a mark if its last word is one, or if all its words
are marks or words of layout ("ad-box", "site-footer"; not "legal-analysis").

Wrappers are inferred within each task, and the few of a host are then aligned with each other in two
steps, so a host of any number of pages adds one small wrapper per task. Pages are read along their host's
wrapper afterwards.

Defined results: null and empty html give an empty text; a null url, or one without a host, belongs
to the host "" (its pages share a wrapper); unclosed tags end where their parent ends; an unclosed
comment, script or style runs to the end; repeated rows each give a row; an empty table gives an empty
result; html of any length and depth is read whole (blocks below DEEPEST others are siblings in the wrapper's
tree, as which they are grouped, while their slots still go by all they stand in); columns besides
page_id, url and html play no part and may have any name.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import prepare, staged
from riskloom.llm.linkrank import host

#: Bytes of wrappers' slots that are broadcast at most; beyond, pages are shuffled to them.
BROADCAST_BYTES = 16 << 20
#: Blocks within blocks up to which a wrapper's tree is one; what is deeper is a sibling there.
DEEPEST = 150
#: Different pages that must have a text in an article for it to be the template's.
FIRM = 5
#: Groups in which a host's wrappers are aligned before those are.
GROUPS = 32

# fixed values: elements of HTML and words in their marks
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul button iframe noscript object svg template textarea head title label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe svg button select option optgroup textarea menu dialog "
    "object head title label fieldset legend".split()
)
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer "
    "masthead toolbar comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe "
    "signup login search widget pagination pager copyright legal disclaimer hidden".split()
)
#: Words of layout, which don't keep a name of marks from being one.
LAYOUT = frozenset(
    "area bar block bottom box button buttons col column container desktop field fixed global group holder icons inner item items left "
    "link links list mobile outer panel posts primary reader right row secondary section site slot sticky top unit user wrap wrapper".split()
)
#: Marks that also count on article and main themselves.
STRONG_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Tags that a start tag ends, if they are open in the same parent.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Blocks that don't end a paragraph.
IN_PARAGRAPH = frozenset("button iframe noscript object svg template textarea select option optgroup label head title body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _marked(name: str, marks: frozenset[str]) -> bool:
    """Whether one of the classes or ids in name is a mark."""
    for one in name.split():
        words = [w.lower() for w in _WORD.findall(one)]
        if words and not marks.isdisjoint(words) and (words[-1] in marks or all(w in marks or w in LAYOUT for w in words)):
            return True
    return False


def _label(tag: str, attributes: str) -> str:
    """A tag with its class, id and role; digits as 0; a leading ! if it is marked as other than main text."""
    if not attributes.strip():
        return ("!" if tag in BOILERPLATE_TAGS else "") + tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    name = " ".join(found.get(k, "") for k in ("class", "id"))
    strict = STRONG_MARKS if tag in ("article", "main") else MARKS
    bad = tag in BOILERPLATE_TAGS or "hidden" in found or found.get("role", "").lower() in ROLES
    bad = bad or tag not in ("html", "body") and _marked(name, strict)
    main = found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    mark = _DIGITS.sub("0", ".".join(sorted(name.lower().split())))
    return ("!" if bad else "") + tag + ("*" if main else "") + ("." + mark if mark else "")


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """("<", label), (">", ""), ("#", text, whether all of it is links): starts and ends of blocks, balanced, and the text of each run."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of each tag in the stack
    text: list[str] = []
    labels: dict[tuple[str, str], str] = {}
    link: int | None = None  # blocks that were open where the link began
    plain = False

    def run() -> Iterator[tuple[str, str, bool]]:
        nonlocal plain
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                yield "#", whole, not plain
        plain = False

    def close(depth: int) -> Iterator[tuple[str, str, bool]]:
        nonlocal link
        while len(stack) > depth:
            places[stack.pop()].pop()
            yield ">", "", False
        if link is not None and len(stack) < link:  # a link ends with the block it began in
            link = None

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            plain = plain or link is None and not text[-1].isspace()
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if tag == "a":
            link = len(stack) if not m[2] and "href" in m[4].lower() else None
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        yield from run()
        if m[2]:
            if places.get(tag):
                yield from close(places[tag][-1])
            continue
        if tag not in IN_PARAGRAPH and places.get("p"):
            yield from close(places["p"][-1])
        if tag in ENDS:
            scope = max((places[x][-1] for x in SCOPES.get(tag, ("table",)) if places.get(x)), default=-1)
            ended = [places[x][k] for x in ENDS[tag] if places.get(x) and (k := bisect_right(places[x], scope)) < len(places[x])]
            if ended:
                yield from close(min(ended))
        key = (tag, m[4] or "")
        label = labels.get(key)
        if label is None:
            label = labels[key] = _label(*key)
        yield "<", label, False
        if tag in VOID or m[0].endswith("/>") and tag in ("hr", "svg", "iframe"):
            yield ">", "", False
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(tag)
    rest = page[at:]
    text.append(rest[: cut.start()] if (cut := re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)) else rest)
    plain = plain or link is None and not text[-1].isspace()
    yield from run()
    yield from close(0)


def slots(page: str) -> Iterator[tuple[int, bool, bool, str, bool]]:
    """(slot, whether it is marked as other than main text, whether it is in an article, text, whether all of it is links)."""
    for kind, at, value, linked in _placed(page):
        if kind == "#":
            yield *at, value, linked


def _placed(page: str) -> Iterator[tuple[str, tuple[int, bool, bool], str, bool]]:
    """events() with the slot and what it stands in."""
    path = [(0, False, False)]
    for kind, value, linked in events(page):
        if kind == "<":
            slot, marked, article = path[-1]
            path.append((_below(slot, value), marked or value.startswith("!"), article or _is_article(value)))
        elif kind == ">":
            path.pop()
        yield kind, path[-1], value, linked


def _below(slot: int, label: str) -> int:
    """The slot in a block with this label, from that around it."""
    return xxhash.xxh3_64_intdigest(label, seed=slot)


def _is_article(label: str) -> bool:
    name = label.partition(".")[0]
    return name in ("article", "main") or name.endswith("*")


# A node of a wrapper is [label, optional, repeated, children]; a group of several has the label "("; a text has "#" and its slots as children.
# What is known of a slot is (pages, texts, linked): up to FIRM of the pages that have it (hashes of their texts), the texts that
# all pages with it have, and whether all its texts are links.
Known = tuple[set[int], set[int], bool]


def page_wrapper(page: str) -> tuple[list, dict[int, Known]]:
    """The wrapper of one page: its tree, with repeats found, and what is known of its unmarked slots."""
    top: list = []
    open_, depth = [top], 0
    texts: dict[int, set[int]] = {}
    plain: set[int] = set()
    for kind, (slot, marked, _), value, linked in _placed(page):
        if kind == "<":
            depth += 1
            node = [value, False, False, []]
            open_[-1].append(node)
            if depth <= DEEPEST:
                open_.append(node[3])
        elif kind == ">":
            if depth <= DEEPEST:
                children = open_.pop()
                children[:] = folded(children)
            depth -= 1
        else:
            open_[-1].append(["#", False, False, [slot]])
            if not marked:
                texts.setdefault(slot, set()).add(xxhash.xxh3_64_intdigest(value))
                if not linked:
                    plain.add(slot)
    own = xxhash.xxh3_64_intdigest(repr(sorted((p, sorted(t)) for p, t in texts.items())))
    return folded(top), {p: ({own}, t, p not in plain) for p, t in texts.items()}


def page_tree(page: str) -> list:
    """The tree of page_wrapper()."""
    return page_wrapper(page)[0]


def joined(a: dict[int, Known], b: dict[int, Known]) -> dict[int, Known]:
    """What is known of the slots of both wrappers' pages; adds b to a."""
    for slot, (pages, texts, linked) in b.items():
        if slot in a:
            own, common, links = a[slot]
            a[slot] = (set(sorted(own | pages)[:FIRM]), common & texts, links and linked)
        else:
            a[slot] = (pages, texts, linked)
    return a


def _name(node: list) -> object:
    return (node[0], *map(_name, node[3])) if node[0] == "(" else node[0]


def merged(a: list, b: list) -> list:
    """One node that both a and b, of equal name, fit."""
    below = sorted({*a[3], *b[3]}) if a[0] == "#" else aligned(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2], below]


def folded(nodes: list) -> list:
    """Repeats made groups: first neighbours of one name, then runs of two to four names."""
    if len(nodes) < 2:
        return nodes
    out: list = []
    for node in nodes:
        if out and _name(out[-1]) == _name(node):
            last = merged(out[-1], node)
            last[1], last[2] = out[-1][1] and node[1], True
            out[-1] = last
        else:
            out.append(node)
    for size in (2, 3, 4):
        at = 0
        while at + 2 * size <= len(out):
            first = out[at : at + size]
            names = [_name(x) for x in first]
            end = at + size
            while [_name(x) for x in out[end : end + size]] == names:
                first = [merged(x, y) for x, y in zip(first, out[end : end + size], strict=True)]
                end += size
            if end > at + size:
                out[at:end] = [["(", False, True, first]]
            at += 1
    return out


def aligned(a: list, b: list) -> list:
    """The union-free alignment of two lists of siblings."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for k, l in [*common([_name(x) for x in a], [_name(x) for x in b]), (len(a), len(b))]:
        out += [[n[0], True, n[2], n[3]] for n in [*a[i:k], *b[j:l]]]
        if k < len(a):
            out.append(merged(a[k], b[l]))
        i, j = k + 1, l + 1
    return folded(out)


def common(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, for lists of any length: a row of its table is the bits of one integer."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    left, right = a[start : len(a) - end], b[start : len(b) - end]
    where: dict = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, []
    for x in left:  # a bit is 0 where the length grows in this row
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    found, i, j = [], len(left), len(right)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((start + i, start + j))
    same = [(k, k) for k in range(start)] + found[::-1]
    return same + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def as_regex(nodes: list) -> str:
    """A wrapper written out: <tag>, #, ( )+, ( )?."""
    parts = []
    for label, optional, repeated, children in nodes:
        inner = "" if label == "#" else as_regex(children)
        text = "#" if label == "#" else inner if label == "(" else f"<{label}>{inner}</>"
        sign = "*" if optional and repeated else "+" if repeated else "?" if optional else ""
        parts.append(f"({text}){sign}" if sign else text)
    return "".join(parts)


def repeated_slots(nodes: list, inside: bool = False) -> Iterator[int]:
    """The slots in repeated groups."""
    for label, _, repeated, children in nodes:
        if label != "#":
            yield from repeated_slots(children, inside or repeated)
        elif inside or repeated:
            yield from children


def told(tree: list, known: dict[int, Known]) -> tuple[dict[int, set[int]], set[int], set[int]]:
    """What a host's wrapper tells of its slots: (the template's texts by slot, menus, slots that FIRM pages have)."""
    shared = {slot: k for slot, k in known.items() if len(k[0]) > 1}
    menus = {slot for slot in repeated_slots(tree) if slot in shared and shared[slot][2]}
    return {slot: texts for slot, (_, texts, _) in shared.items() if texts}, menus, {slot for slot, (pages, _, _) in shared.items() if len(pages) >= FIRM}


def main_text(
    page: str, template: dict[int, set[int]] | None = None, menus: set[int] | frozenset[int] = frozenset(), firm: set[int] | frozenset[int] = frozenset()
) -> str:
    """The page's own texts: those in articles, or all unmarked ones if there are none; one line per block."""
    first, second = [], []
    template = template or {}
    for slot, marked, article, text, _ in slots(page):
        if marked or slot in template and (slot in firm or not article) and xxhash.xxh3_64_intdigest(text) in template[slot]:
            continue
        if article:
            first.append(text)
        elif slot not in menus:
            second.append(text)
    return "\n".join(first or second)


def _written(tree: list, known: dict[int, Known]) -> str:
    return json.dumps([tree, [[slot, sorted(pages), sorted(texts), linked] for slot, (pages, texts, linked) in sorted(known.items())]])


def _read(text: str) -> tuple[list, dict[int, Known]]:
    tree, known = json.loads(text)
    return tree, {slot: (set(pages), set(texts), linked) for slot, pages, texts, linked in known}


def _one(table: pa.Table) -> pa.Table:
    """The wrappers of a host as one."""
    trees: set[str] = set()
    known: dict[int, Known] = {}
    for text in table.column("wrapper").to_pylist():
        tree, more = _read(text)
        trees.add(json.dumps(tree))
        known = joined(known, more)
    out: list | None = None
    for text in sorted(trees):
        tree = json.loads(text)
        out = tree if out is None else aligned(out, tree)
    return pa.table({"host": table.column("host")[:1], "wrapper": [_written(out, known)]})


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of the pages of each host in the task."""
    own: dict[str, list] = {}
    known: dict[str, dict[int, Known]] = {}
    seen: set[tuple[str, str]] = set()

    def all_() -> pa.RecordBatch:
        made = [_written(tree, known[name]) for name, tree in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(made, pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree, more = page_wrapper(page)
            known[name] = joined(known.get(name, {}), more)
            key = (name, json.dumps(tree))
            if key not in seen:
                seen.add(key)
                own[name] = aligned(own[name], tree) if name in own else tree
            if len(own) > 5000 or len(seen) > 50_000:
                yield all_()
                for x in (own, known, seen):
                    x.clear()
    if own:
        yield all_()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON: its tree, and what is known of its slots) of url, html."""
    prepare(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    fields = "host string, wrapper string"
    some = rows.mapInArrow(_inferred, fields).withColumn("g", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    return some.groupBy("host", "g").applyInArrow(_one, fields).groupBy("host").applyInArrow(_one, fields)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    made = staged(wrappers(pages), "page-wrappers")
    size = made.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "host", "left").select("page_id", "url", "html", "wrapper")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict[int, set[int]], set[int], set[int]]] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = told(*_read(wrapper or "[[], []]"))
                texts.append(main_text(page or "", *known[wrapper]))
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
