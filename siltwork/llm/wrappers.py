"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page's token stream (tags with their class words, and text slots) becomes an ordered expression: each
item is mandatory or optional, single or repeated, and holds its own items. Two expressions are aligned
item by item (containers only with containers of like content); items that have no partner become optional, neighbours
that are alike become a repeated group, and texts that differ become slots. Wrappers of one host are folded on every
task and then merged in two shuffled steps (alignment is folded, so no task holds the pages of a host).

The rule of a host follows from its wrapper: the item whose slots hold most of the running text that varies from page to
page is the article; a single text that is the same on all pages is template and goes. Names of tags and classes decide
between nested items, and what inside an article is no part of it. A page is then matched against the wrapper,
item by item, and its text is what its kept items hold, in one narrow pass.

Defined results: a null or empty html gives an empty text; a page of which the rule of its host keeps nothing is read
by the wrapper of that page alone; a null or odd url counts as the host ''; repeated rows are read each on its own; pages of
any length are read whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.batches import sliced
from siltwork.sources.session import shared_folder

SCHEMA = "page_id long, url string, text string, n_chars long"

#: A tag that is not closed ends before the next one.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(script|style|noscript|template|iframe|svg|math|canvas|object|textarea|select|title)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Tags that end an open paragraph and part blocks of text.
BLOCKS = set(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option optgroup output p pre section summary table tbody td tfoot th thead tr ul video audio caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends the open tags named here, up to the tags named after them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPH_ENDS = BLOCKS - {"br", "body", "html", "head", "option", "optgroup"}
_SCOPE = {"table", "td", "th", "article", "section", "main", "body", "li", "ul", "ol", "blockquote"}

#: Tags and names of what surrounds an article.
BOILER_TAGS = set("nav footer aside form button dialog menu head label fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay promo promotion sponsor sponsored share sharing social related recommended recommendations sidebar side rail widget widgets newsletter subscribe subscription signup login search "
    "menu nav navbar navigation topbar toolbar header footer masthead pagination pager copyright legal disclaimer skip hidden tags tagcloud byline-share donate paywall".split()
)
CONTENT_NAMES = set("article articlebody content main maincontent post postbody postcontent entry entrycontent story storybody body text".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements below so many others are no items of their own: their text belongs to the item above, unless named as boilerplate.
_DEEPEST = 60
#: Elements that only lay out others: two of a label are alike if what they hold is.
CONTAINERS = set("div section td table tbody tr ul ol li dl form fieldset center span".split())
_RUNNING = set("p pre span b i strong em a dt blockquote".split()) | _HEADINGS
#: A list of more items than this has its rarest ones generalised to one item for each tag.
MOST_ITEMS = 64
#: From so many pages of a host on one sees what is the same on all. It helps to find the article, and takes the
#: template's texts out where no name shows the article's borders; inside an element named as the article nothing goes by it.
TEMPLATE_PAGES = 2


def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words: lower case, without digits, sorted."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    words = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            words.add(".hidden")
        elif name == "role":
            words |= {"@" + w for w in value.split()}
        elif name in ("class", "id", "itemprop"):
            words |= {"." + re.sub(r"\d+", "", w) for w in value.split()}
    return tag + "".join(sorted(w for w in words if len(w) > 1))


@lru_cache(1 << 16)
def tag_of(label: str) -> str:
    return re.split(r"[.@*]", label, maxsplit=1)[0]


@lru_cache(1 << 16)
def is_boilerplate(label: str, inside_content: bool = False) -> bool:
    tag, *names = re.split(r"[.@*]", label)
    if tag in BOILER_TAGS:
        return True
    if tag == "header":
        return not inside_content
    if tag in ("body", "html", "article", "main") or tag in _HEADINGS:
        return "hidden" in names
    for n in names:
        if n in BOILER_NAMES or n in BOILER_ROLES or any(w in BOILER_NAMES for w in re.split(r"[-_]", n)):
            return not ({n, n.replace("-", "").replace("_", "")} & CONTENT_NAMES)
    return False


def walk(html: str):
    """Yields ('open', label, whether it is an item), ('close', tag, whether it is an item), ('text', string, in link), ('break', None, None)."""
    stack: list[tuple[str, bool]] = []  # tag, whether it was announced
    places: dict[str, list[int]] = {}  # where in the stack each tag stands
    depth = 0
    at = 0

    def pop():
        nonlocal depth
        tag, shown = stack.pop()
        places[tag].pop()
        depth -= shown
        return ("close", tag, shown)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield ("text", entities.unescape(html[at : m.start()]), bool(places.get("a")))
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                yield ("text", m[0][9:].removesuffix("]]>"), bool(places.get("a")))
            elif m[1] and m[1].lower() in BLOCKS:
                yield ("break", None, None)
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if places.get(tag) and tag not in ("body", "html"):
                while True:
                    end = pop()
                    yield end
                    if end[1] == tag:
                        break
            elif tag in BLOCKS:
                yield ("break", None, None)
            continue
        if tag in VOID:
            if tag in BLOCKS:
                yield ("break", None, None)
            continue
        ends, scope = CLOSES.get(tag, ({"p"} if tag in _PARAGRAPH_ENDS else set(), _SCOPE))
        if ends:
            while (k := last(ends)) >= 0 and k > last(scope):
                while len(stack) > k:
                    yield pop()
        if tag in ("html", "body") and places.get(tag):
            continue
        attributes = m[4] or m[7] or ""
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        shown = depth < _DEEPEST
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, shown))
        depth += shown
        yield ("open", _label(tag, attributes), shown)
    if at < len(html):
        yield ("text", entities.unescape(html[at:]), bool(places.get("a")))
    while stack:
        yield pop()


def tree(html: str | None) -> list:
    """A page's elements: [label, what it holds: elements, (text, whether in a link), None where blocks part]. Elements too
    deep to be items give their texts to the item above."""
    root: list = ["html", []]
    path = [root]
    below: list[bool] = []  # of the elements below the deepest items: whether they are boilerplate or inside it
    for kind, value, more in walk(html or ""):
        if kind == "text":
            if value and not (below and below[-1]):
                path[-1][1].append((value, more))
        elif kind == "break":
            path[-1][1].append(None)
        elif kind == "open" and more:
            path[-1][1].append([value, []])
            path.append(path[-1][1][-1])
        elif kind == "close" and more:
            path.pop()
        else:
            if tag_of(value) in BLOCKS:
                path[-1][1].append(None)
            if kind == "open":
                below.append(bool(below) and below[-1] or is_boilerplate(value, True))
            else:
                below.pop()
    return root


# An expression's item: [label, least, most (1 or 2 for many), items, slot, pages]; a slot: [pages, chars, link chars, digest of the text if all pages have the same, else None].


def _digest(text: str) -> str:
    """Of a whole text, blanks aside."""
    return hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def page_expression(page: list | str) -> list:
    label, kids = tree(page) if isinstance(page, str) else page
    items: list = []
    for kid in kids:
        if isinstance(kid, list):
            items.append(page_expression(kid))
        elif kid and (text := " ".join(kid[0].split())):
            slot = ["#", 1, 1, [], [1, len(text), len(text) if kid[1] else 0, _digest(text)], 1]
            if items and items[-1][0] == "#":
                items[-1] = merge_items(items[-1], slot, joined=True)
            else:
                items.append(slot)
    return [label, 1, 1, generalise(collapse(items)), None, 1]


def _joint(a: str | None, b: str | None) -> str | None:
    """The digest of two texts side by side."""
    return None if a is None or b is None else _digest(f"{a} {b}")


def merge_items(a: list, b: list, joined: bool = False) -> list:
    """One item that matches what either matches; ``joined``: both stand side by side, so it is a repeated one."""
    slot = None
    if a[4] or b[4]:
        x, y = a[4] or [0, 0, 0, None], b[4] or [0, 0, 0, None]
        slot = [max(x[0], y[0]) if joined else x[0] + y[0], x[1] + y[1], x[2] + y[2], _joint(x[3], y[3]) if joined else x[3] if x[3] == y[3] else None]
    return [a[0], max(a[1], b[1]) if joined else min(a[1], b[1]), 2 if joined else max(a[2], b[2]), align(a[3], b[3]), slot, max(a[5], b[5]) if joined else a[5] + b[5]]


def shape(kids: list[tuple[str, list[str]]]) -> frozenset:
    """What lies in an element, from the label of each element in it and the labels in these: blocks, or inline elements where there are none."""

    def main(labels: list[str]) -> list[str]:
        return [x for x in labels if tag_of(x) in BLOCKS] or labels

    shown = set(main([x for x, _ in kids]))
    return frozenset(f"{x}>{y}" for x, inner in kids if x in shown for y in (main(inner) if tag_of(x) in CONTAINERS and inner else [""]))


def item_shape(item: list) -> frozenset:
    return shape([(x[0], [y[0] for y in x[3] if y[0] != "#"]) for x in item[3] if x[0] != "#"])


def element_shape(element: list) -> frozenset:
    return shape([(x[0], [y[0] for y in x[1] if isinstance(y, list)]) for x in element[1] if isinstance(x, list)])


def likeness(a: frozenset, b: frozenset) -> float:
    return 1.0 if a == b else len(a & b) / len(a | b)


def alike(a: list, b: list) -> bool:
    """Two items of one label; containers also need like content."""
    return a[0] == b[0] and (tag_of(a[0]) not in CONTAINERS or likeness(item_shape(a), item_shape(b)) >= 0.5)


def collapse(items: list) -> list:
    """Neighbours that are alike, and repeated groups of up to four items, become repeated ones."""
    out: list = []
    for item in items:
        out.append(item)
        for size in (1, 2, 3, 4):
            if len(out) >= 2 * size and all(map(alike, out[-2 * size : -size], out[-size:])):
                tail = [merge_items(a, b, joined=True) for a, b in zip(out[-2 * size : -size], out[-size:], strict=True)]
                out[-2 * size :] = tail
                break
    return out


def generalise(items: list) -> list:
    """Of too many items, the rarest become one optional, repeated item for each tag, so that names which differ from page to page do not let a wrapper grow."""
    if len(items) <= MOST_ITEMS:
        return items
    rare = {id(x) for x in sorted(items, key=lambda x: (x[5], x[0] != "#"))[: len(items) - MOST_ITEMS // 2]}
    out: list = []
    wild: dict[str, int] = {}
    for x in items:
        tag = tag_of(x[0])
        if id(x) not in rare and not x[0].endswith("*"):
            out.append(x)
        elif tag in wild:
            out[wild[tag]] = merge_items(out[wild[tag]], [out[wild[tag]][0], *x[1:]], joined=True)
        else:
            wild[tag] = len(out)
            out.append(["#" if tag == "#" else tag + "*", 0, 2, *x[3:]])
    return out


def _keys(*lists: list) -> list[list]:
    """Items of all lists that are alike get one key."""
    seen: dict[str, list] = {}
    out = []
    for items in lists:
        keys = []
        for x in items:
            known = seen.setdefault(x[0], [])
            k = next((n for n, y in enumerate(known) if alike(x, y)), len(known))
            if k == len(known):
                known.append(x)
            keys.append((x[0], k))
        out.append(keys)
    return out


def align(a: list, b: list) -> list:
    """Aligns two sequences of items; what has no partner becomes optional."""
    la, lb = [x[0] for x in a], [x[0] for x in b]
    if la == lb and len(set(la)) == len(la):
        return [merge_items(x, y) for x, y in zip(a, b, strict=True)]
    ka, kb = _keys(a, b)
    if ka == kb:
        return [merge_items(x, y) for x, y in zip(a, b, strict=True)]
    optional = lambda x: [x[0], 0, *x[2:]]
    out: list = []
    for op, i, j, k, l in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge_items(x, y) for x, y in zip(a[i:j], b[k:l], strict=True)]
        else:
            out += [optional(x) for x in a[i:j]] + [optional(x) for x in b[k:l]]
    return generalise(collapse(out))


def pattern(item: list) -> str:
    """The wrapper as a regular expression over tokens, to read."""
    label, least, most, items, *_ = item
    inner = "#" if label == "#" else f"<{label}>{''.join(map(pattern, items))}</>"
    return inner if (least, most) == (1, 1) else f"({inner}){'?' if (least, most) == (0, 1) else '*' if not least else '+'}"


def _text_chars(item: list, content: bool = False) -> tuple[int, int]:
    """(characters outside links, in links) below an item, without what is named as boilerplate."""
    if item[0] == "#":
        return item[4][1] - item[4][2], item[4][2]
    if is_boilerplate(item[0], content):
        return 0, 0
    inside = content or tag_of(item[0]) in ("article", "main")
    sums = [_text_chars(x, inside) for x in item[3]]
    return sum(x for x, _ in sums), sum(y for _, y in sums)


def _is_template(item: list, pages: int) -> bool:
    """A single element with one text that is the same on all pages of a host with several."""
    return pages >= TEMPLATE_PAGES and item[2] == 1 and tag_of(item[0]) not in _HEADINGS and len(item[3]) == 1 and item[3][0][0] == "#" and item[3][0][4][0] >= pages and item[3][0][4][3] is not None


def _varies(item: list) -> bool:
    return (item[0] == "#" and item[4][3] is None) or any(_varies(x) for x in item[3])


@lru_cache(1 << 16)
def content_strength(label: str) -> int:
    """3: named as an article, 2: as the main part, 1: as content, 0: not at all."""
    tag, *names = re.split(r"[.@*]", label)
    if tag == "article" or "articlebody" in names:
        return 3
    if tag == "main" or "main" in names:
        return 2
    return int(bool({n.replace("-", "").replace("_", "") for n in names} & CONTENT_NAMES))


def article(root: list, pages: int) -> list[list[list]]:
    """The chains of items, from below the root, down to those that hold the article."""
    telling = pages >= TEMPLATE_PAGES and _varies(root)

    def mass(item: list) -> int:
        """Characters outside links in slots that vary; all of them where nothing varies, as on a host with one page."""
        if item[0] == "#":
            return 0 if telling and item[4][0] >= TEMPLATE_PAGES and item[4][3] is not None else item[4][1] - item[4][2]
        return 0 if is_boilerplate(item[0]) else sum(map(mass, item[3]))

    by_slots: list[list] = []
    item = root
    while True:  # goes down as long as one item holds most of the text
        weights = [(mass(x), k) for k, x in enumerate(item[3]) if x[0] != "#"]
        most, k = max(weights, default=(0, 0), key=lambda w: (w[0], -w[1]))
        if not most or item[3][k][2] > 1 or tag_of(item[3][k][0]) in _RUNNING or most < 0.8 * sum(map(mass, item[3])):
            break
        item = item[3][k]
        by_slots.append(item)

    named: list[tuple[int, list]] = []

    def seek(item: list, chain: list) -> None:
        if item[0] == "#" or is_boilerplate(item[0]):
            return
        chain = [*chain, item]
        strength = content_strength(item[0])
        if strength:
            named.append((strength, chain))
        for x in item[3]:
            seek(x, chain)

    for x in root[3]:
        seek(x, [])
    whole = sum(_text_chars(root)) or 1
    same = lambda a, b: all(x is y for x, y in zip(a, b, strict=False))  # noqa: E731  one chain goes on the other
    for strength in (3, 2, 1):
        of = [c for s, c in named if s == strength and sum(_text_chars(c[-1])) >= 0.25 * whole]
        if of:
            best = [max(of, key=lambda c: sum(_text_chars(c[-1])))] if strength < 3 else [c for c in of if not any(len(d) < len(c) and same(d, c) for d in of)]
            # Names only move the border of the item that the slots point to.
            if any(same(c, by_slots) for c in best):
                return best
    return [by_slots]


_OUT, _PASS, _IN, _TEMPLATE = range(4)


def choose(root: list, pages: int) -> list:
    """The rule of a wrapper, an item for each of its items that matters: [label, what becomes of it, digest of a template's text, items, labels of what it holds]."""
    chains = article(root, pages)
    ends = {id(c[-1]) if c else id(root) for c in chains}
    above = {id(x) for c in chains for x in c} | {id(root)}

    def part(item: list, what: int, items: list = (), digest: str | None = None) -> list:
        return [item[0], what, digest, list(items), sorted(item_shape(item))]

    def kept(item: list, varies: bool, repeated: bool, top: bool) -> list:
        items = []
        for x in item[3]:
            if x[0] == "#":
                continue
            if is_boilerplate(x[0], True):
                items.append(part(x, _OUT))
            elif varies and not repeated and _is_template(x, pages):
                items.append(part(x, _TEMPLATE, digest=x[3][0][4][3]))
            elif top and tag_of(x[0]) in CONTAINERS and _only_links(x):
                items.append(part(x, _OUT))
            else:
                items.append(kept(x, varies, repeated or x[2] > 1, False))
        plain = all(x[1] == _IN and not x[3] for x in items)
        return part(item, _IN, () if plain else items)

    def build(item: list) -> list:
        if id(item) in ends:
            # Lists of links beside the text go where no item holds the article alone.
            return kept(item, _varies(item) and not content_strength(item[0]), False, tag_of(item[0]) in ("html", "body"))
        return part(item, _PASS, [build(x) for x in item[3] if x[0] != "#"]) if id(item) in above else part(item, _OUT)

    return build(root)


def _only_links(item: list) -> bool:
    plain, linked = _text_chars(item, True)
    return linked > 0 and plain <= 0.1 * linked


def _match(kid: list, items: list, at: int) -> int | None:
    """The item of a rule that an element stands for: of those with its label the one of the most like content, from ``at`` on if it can be."""
    of = [k for k, x in enumerate(items) if x[0] == kid[0]] or [k for k, x in enumerate(items) if x[0] == tag_of(kid[0]) + "*"]
    if len(of) < 2:
        return of[0] if of else None
    own = element_shape(kid)
    return max(of, key=lambda k: (likeness(own, frozenset(items[k][4])), k >= at, -k))


def extract(page: list | str, rule: list) -> str:
    """The text of a page by a rule: its elements are matched with the rule's items. A template's text goes only where its item holds just that text."""
    blocks: list[list[str]] = [[]]

    def go(node: list, items: list, inside: bool) -> None:
        at = 0
        for kid in node[1]:
            if kid is None:
                blocks.append([])
            elif isinstance(kid, tuple):
                if inside:
                    blocks[-1].append(kid[0])
            else:
                k = _match(kid, items, at) if items else None
                block = tag_of(kid[0]) in BLOCKS
                if block:
                    blocks.append([])
                if k is None:
                    if inside and not is_boilerplate(kid[0], True):
                        go(kid, [], True)
                else:
                    at = k
                    what, digest = items[k][1], items[k][2]
                    if what == _TEMPLATE:
                        own = [x for x in kid[1] if x is not None and (isinstance(x, list) or x[0].strip())]
                        what = _OUT if len(own) == 1 and isinstance(own[0], tuple) and _digest(own[0][0]) == digest else _IN
                    if what != _OUT:
                        go(kid, items[k][3], what == _IN)
                if block:
                    blocks.append([])

    go(tree(page) if isinstance(page, str) else page, rule[3], rule[1] == _IN)
    return " ".join(" ".join("".join(b).split()) for b in blocks if "".join(b).strip())


def page_text(html: str | None, rule: list | None) -> str:
    if not html:
        return ""
    page = tree(html)
    text = extract(page, rule) if rule else ""
    return text or extract(page, choose(page_expression(page), 1))


def host(url_column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url_column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: So many hosts' wrappers are held by one task at once.
_HELD = 2000
WRAPPER_SCHEMA = "host string, part int, pages long, wrapper string"


def wrappers(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """host, pages, wrapper: the expression of all pages of each host."""

    def fold(batches):
        held: dict[str, list] = {}

        def rows():
            out = {"host": list(held), "part": [hash_part(h, k) for k, h in enumerate(held)], "pages": [n for n, _ in held.values()], "wrapper": [json.dumps(w) for _, w in held.values()]}
            held.clear()
            return pa.RecordBatch.from_pydict(out, pa.schema([("host", pa.string()), ("part", pa.int32()), ("pages", pa.int64()), ("wrapper", pa.string())]))

        for part, texts in sliced(batches, "html"):
            for h, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if text:
                    own = page_expression(text)
                    n, known = held.get(h, (0, None))
                    held[h] = (n + 1, merge_items(known, own) if known else own)
            if len(held) > _HELD:
                yield rows()
        if held:
            yield rows()

    def hash_part(h: str, k: int) -> int:
        from pyspark import TaskContext

        return (TaskContext.get().partitionId() + k) % 64

    def merge(table: pa.Table) -> pa.Table:
        known, n = None, 0
        for pages_, w in sorted(zip(table.column("pages").to_pylist(), table.column("wrapper").to_pylist(), strict=True)):
            known = merge_items(known, json.loads(w)) if known else json.loads(w)
            n += pages_
        return pa.table({"host": [table.column("host")[0].as_py()], "part": pa.array([0], pa.int32()), "pages": pa.array([n], pa.int64()), "wrapper": [json.dumps(known)]})

    src = pages.select(host(pages[url_column]).alias("host"), pages[html_column].alias("html"))
    folded = src.mapInArrow(fold, WRAPPER_SCHEMA)
    return folded.groupBy("host", "part").applyInArrow(merge, WRAPPER_SCHEMA).groupBy("host").applyInArrow(merge, WRAPPER_SCHEMA).drop("part")


#: Rules of up to so many bytes in all are broadcast; beyond, pages are joined with them by shuffle.
BROADCAST_RULES = 32 << 20


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page with the text of its article."""

    def rule(batches):
        for batch in batches:
            out = [json.dumps(choose(json.loads(w), n)) for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["rule_host", "rule"])

    def read(batches):
        known: dict[str, list] = {}
        for part, texts in sliced(batches, "html"):
            out = []
            for html, r in zip(texts, part.column(3).to_pylist(), strict=True):
                if r is not None and r not in known:
                    if len(known) > _HELD:
                        known.clear()
                    known[r] = json.loads(r)
                out.append(page_text(html, known.get(r)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    shared_folder(pages.sparkSession)
    src = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), pages[html_column].alias("html"))
    rules = wrappers(src).select("host", "pages", "wrapper").mapInArrow(rule, "rule_host string, rule string").checkpoint()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("rule_host")), F.lit(0))).first()[0]
    side = F.broadcast(rules) if size <= BROADCAST_RULES else rules
    return src.join(side, host(F.col("url")) == F.col("rule_host"), "left").select("page_id", "url", "html", "rule").mapInArrow(read, SCHEMA)
