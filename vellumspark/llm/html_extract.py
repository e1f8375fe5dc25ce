"""Main-text extraction from HTML with wrappers inferred per host.

A page is read into block elements and blocks of text (runs of text and inline markup). For each host the block
streams of a bounded sample of pages (``sample_pages``, drawn by a hash of the html) are aligned one after
another: stretches that repeat become repeated groups, stretches that some pages lack become optional groups,
texts that differ become slots, and texts that all pages share become template text. The result is a union-free
regular expression, the host's wrapper. Its article is found by the mass of its slots: the lowest element that
holds nine tenths of the text that varies from page to page, raised to the element that also holds the page's
first heading, or to an ``article`` around it. So menus, notices and the like that repeat over a host's pages are
told from the article where no name tells them apart; and template text within the article is left out too, where
at least ``least_same`` pages show it (headings stay). Pages that are copies of each other count once there, so
that a repeated article is no template.

A page that fits its host's wrapper is read from the region that matching gives; one that doesn't fit, from the
element with the same path; and a page of a host without a wrapper (fewer than two pages that differ) by
``article``, else ``main``, else an element whose class says content, else the body. Elements whose tag or role
says menu, header, footer, sidebar, notice, advert or form are left out. Classes and ids count only where all their
words say so ("related-posts", not "related-work"), and not if the element holds the marked article or, with no
article marked, half of the page's text.

Character references are decoded after markup is told apart; white space in a block is one space; blocks are
joined by line ends; ``br`` is white space. Whole pages are read, nothing is capped; time is linear in a page's
length, however broken its markup.

Defined cases: null html counts as empty and gives the empty text; a null or odd url belongs to the host of
empty name; repeated rows are extracted each; broken markup never raises; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cached_property
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import cut

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOPS = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set("nav header footer aside form script style textarea title noscript iframe template button select option menu dialog svg math canvas object audio video head datalist".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav aside "
    "header masthead topbar footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login comment comments commentlist respond reply "
    "replies discussion disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager skiplink form search searchform hidden copyright".split()
)
#: Words that may stand beside a noise word without giving it another sense.
PLACE_WORDS = set(
    "area article articles bar block body bottom box btn button buttons card cards col column container content count entry fixed global grid group icon icons inline inner item items js left link links list "
    "main media mobile module new page panel post posts primary reader readers right row secondary section site slot small sticky stories story text the thread title top unit user users wrap wrapper zone".split()
)
#: Noise words that on an element of prose may as well speak of its content.
PROSE_WORDS = set("comment comments discussion header footer related social reply replies respond form search menu status".split())
NAMED_PROSE = set("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption caption td".split())
#: Elements too small to be an article's.
PROSE = set("p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt ul ol dl figcaption caption address td th tr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_WORDS = set("article content post entry story".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "dd", "dt", "li"}
#: What an opening tag ends, and inside which element that search stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}

VARYING, COPIES, ITEMS = 0.9, 0.5, 20_000
OPEN, CLOSE, TEXT = 0, 1, 2


def _noise_names(names: str, prose: bool) -> bool:
    """Whether a class or id says that its element is no content: all words of one of its names do."""
    for name in names.split():
        words = set(WORDS.findall(CAMEL.sub(" ", name).lower()))
        noise = words & NOISE_WORDS
        if noise and words <= NOISE_WORDS | PLACE_WORDS and not (prose and noise <= PROSE_WORDS):
            return True
    return False


def _describe(tag: str, attributes: str) -> tuple[str, str]:
    """An element's kind (N: left out; n: left out by its names; A, M, C: article by tag, main, names; or empty) and its mark."""
    if tag in NOISE_TAGS:
        return "N", tag
    if not attributes or attributes.isspace():
        return "A" if tag == "article" else "M" if tag == "main" else "", tag
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    role = found.get("role", "").lower()
    if role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "N", tag
    names = found.get("class", "") + " " + found.get("id", "")
    # names with numbers in them differ from page to page
    mark = " ".join([tag, *sorted({x for x in names.split() if sum(c.isdigit() for c in x) < 3})])
    if tag in ("html", "body"):
        return "", tag
    if _noise_names(names, tag in NAMED_PROSE):
        return "n", mark
    if tag == "article":
        return "A", mark
    if tag == "main" or role == "main":
        return "M", mark
    return "C" if set(WORDS.findall(CAMEL.sub(" ", names).lower())) & MAIN_WORDS else "", mark


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """The page's ("#", text, ""), ("<", tag, attributes) and ("/", tag, ""); comments and the inside of raw elements are gone."""
    find, at, end, last = html.find, 0, len(html), html.rfind(">")
    quotes = True  # until one is met that is never closed; from then on a tag ends at the next ">"
    while at < end:
        lt = find("<", at)
        if lt < 0 or lt > last:
            yield "#", html[at:], ""
            return
        if lt > at:
            yield "#", html[at:lt], ""
        if html.startswith("<!--", lt):
            close = find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if html.startswith("<![CDATA[", lt):
            close = find("]]>", lt)
            at = close + 3 if close >= 0 else end
            yield "#", html[lt + 9 : close if close >= 0 else end], ""
            continue
        if html.startswith(("<!", "<?"), lt):
            at = find(">", lt) + 1
            continue
        m = NAME.match(html, lt + 1)
        if not m:
            yield "#", "<", ""
            at = lt + 1
            continue
        gt, place = -1, m.end()
        while quotes:
            stop = STOPS.search(html, place)
            if stop and not stop.group(1):
                gt = stop.start()
                break
            close = find(stop.group(1), stop.end()) if stop else -1
            quotes = close >= 0
            place = close + 1
        if gt < 0:
            gt = find(">", m.end())
        at, tag = gt + 1, m.group(1).lower()
        if html[lt + 1] == "/":
            yield "/", tag, ""
            continue
        yield "<", tag, html[m.end() : gt]
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            after = find(">", close.end()) if close else -1
            at = after + 1 if after >= 0 else end
            yield "/", tag, ""


@dataclass
class Page:
    """Block elements in page order (number 0 is the page) and the stream of their opens, closes and texts."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    marks: list[str] = field(default_factory=lambda: [""])
    kinds: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    items: list[tuple[int, int, str]] = field(default_factory=list)  # what, element, text

    def masses(self, skip: set[str] = frozenset(), out: list[bool] | None = None) -> list[int]:
        """Characters of text within each element; texts of these hashes and elements left out don't count."""
        own = [0] * len(self.tags)
        for what, node, text in self.items:
            if what == TEXT and not (out and out[node]) and not (skip and text_hash(text) in skip):
                own[node] += len(text)
        for i in range(len(own) - 1, 0, -1):
            own[self.parents[i]] += own[i]
        return own

    @cached_property
    def left_out(self) -> list[bool]:
        """Elements left out by their names, with all they hold."""
        n = len(self.tags)
        if "n" not in self.kinds:
            return [False] * n
        mass = self.masses()
        holds = [k in ("A", "M", "C") for k in self.kinds]
        marked = [k in ("A", "M") for k in self.kinds]
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
            marked[self.parents[i]] |= marked[i]
        out = [False] * n
        for i in range(1, n):
            keep = holds[i] or (not marked[0] and 2 * mass[i] >= mass[0])
            out[i] = out[self.parents[i]] or (self.kinds[i] == "n" and not keep)
        return out

    def within(self, regions: set[int]) -> list[bool]:
        """Which elements are, or are inside, one of the regions."""
        inside = [False] * len(self.tags)
        for i in range(len(inside)):
            inside[i] = i in regions or (i > 0 and inside[self.parents[i]])
        return inside

    @cached_property
    def steps(self) -> list[str]:
        """Each element's mark with its number among its parent's children of that mark."""
        seen: Counter[tuple[int, str]] = Counter()
        out = []
        for up, mark in zip(self.parents, self.marks):
            seen[up, mark] += 1
            out.append(f"{mark} {seen[up, mark]}")
        return out

    def path(self, node: int) -> list[str]:
        out = []
        while node > 0:
            out.append(self.steps[node])
            node = self.parents[node]
        return out[::-1]

    def at_path(self, path: list[str]) -> int | None:
        """The element with that path."""
        depth = [0] * len(self.tags)  # how many steps of the path lead to an element, -1 if it is off the path
        for i in range(1, len(depth)):
            up = depth[self.parents[i]]
            depth[i] = up + 1 if 0 <= up < len(path) and self.steps[i] == path[up] else -1
            if depth[i] == len(path):
                return i
        return None


def text_hash(text: str) -> str:
    return f"{xxhash.xxh64_intdigest(text):016x}"


def read(html: str) -> Page:
    """The page's blocks; what is left out for its tag or role is gone, with its text."""
    page = Page()
    run: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, block element it is in or is, whether left out
    open_: Counter[str] = Counter()

    def flush(node: int) -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                page.items.append((TEXT, node, text))

    def pop() -> str:
        tag, node, out = stack.pop()
        open_[tag] -= 1
        if tag in BLOCKS:
            before = stack[-1] if stack else ("", 0, False)
            if node != before[1]:
                flush(node)
                page.items.append((CLOSE, node, ""))
            elif not out or not before[2]:
                flush(before[1])
        return tag

    for what, value, attributes in tokens(html):
        if what == "#":
            if not (stack and stack[-1][2]):
                run.append(value)
            continue
        tag = value
        if what == "/":
            if open_[tag]:
                while pop() != tag:
                    pass
            elif tag in BLOCKS:
                flush(stack[-1][1] if stack else 0)
            continue
        if tag in CLOSES_P and open_["p"]:
            while pop() != "p":
                pass
        elif tag in IMPLIED and any(open_[x] for x in IMPLIED[tag][0]):
            ends, stop = IMPLIED[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    break
        node, out = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if tag in BLOCKS:
            flush(node)
        elif tag == "br" and not out:
            run.append(" ")
        if tag in VOID:
            continue
        if not out:
            kind, mark = _describe(tag, attributes)
            out = kind == "N" or (kind == "n" and tag not in BLOCKS)
            if tag in BLOCKS and not out:
                page.tags.append(tag)
                page.marks.append(mark)
                page.kinds.append(kind)
                page.parents.append(node)
                node = len(page.tags) - 1
                page.items.append((OPEN, node, ""))
        stack.append((tag, node, out))
        open_[tag] += 1
    while stack:
        pop()
    flush(0)
    return page


def skeleton(page: Page, same: set[str] | None = None) -> tuple[list[str], list[int]]:
    """The marks that tell a page's shape, and the element of each: "<" opens, ">" closes, "#" is a text, "=" with its hash one of the template."""
    out, marks, nodes = page.left_out, [], []
    for what, node, text in page.items:
        if out[node]:
            continue
        if what == TEXT:
            h = text_hash(text) if same else ""
            marks.append("=" + h if same and h in same else "#")
        else:
            marks.append(("<" if what == OPEN else ">") + page.marks[node])
        nodes.append(node)
    return marks, nodes


def collapse(items: list) -> list:
    """Adjacent equal stretches become a repeated group ("+", items)."""
    items = list(items)
    for period in range(1, 13):
        out, i = [], 0
        while i < len(items):
            unit, n = items[i : i + period], 1
            while items[i + n * period : i + (n + 1) * period] == unit and len(unit) == period:
                n += 1
            if n > 1:
                out.append(unit[0] if period == 1 and unit[0][0] == "+" and not isinstance(unit[0], str) else ("+", tuple(unit)))
                i += n * period
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _core(item) -> object:
    return item if isinstance(item, str) else ("group", tuple(_core(x) for x in item[1]))


def _fold(items: list, units: set[tuple]) -> list:
    """Single occurrences of another page's repeated units, written as groups too."""
    out, i = [], 0
    ordered = sorted(units, key=len, reverse=True)
    while i < len(items):
        for u in ordered:
            if tuple(items[i : i + len(u)]) == u:
                out.append(("+", u))
                i += len(u)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper that covers both: what only one has becomes optional."""
    units = lambda x: {i[1] for i in x if not isinstance(i, str) and i[0] == "+"}
    a, b = _fold(a, units(b)), _fold(b, units(a))
    out: list = []
    for what, i, j, k, m in SequenceMatcher(None, [_core(x) for x in a], [_core(x) for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                if isinstance(x, str) or x == y:
                    out.append(x)
                else:
                    kind = "*" if "*" in (x[0], y[0]) or {x[0], y[0]} == {"?", "+"} else x[0] if x[0] == y[0] else "*"
                    out.append((kind, x[1]))
        else:
            for part in (a[i:j], b[k:m]):
                out += [(("*" if x[0] in "+*" else "?"), x[1]) if not isinstance(x, str) else ("?", (x,)) for x in part] if len(part) == 1 else [("?", tuple(part))] if part else []
    return out


def _regex(items, chars: dict[str, str], slot: str) -> str:
    """The items as a regular expression over one character a mark; a slot takes any text, template text may be missing."""
    out = []
    for x in items:
        if not isinstance(x, str):
            out.append(f"(?:{_regex(x[1], chars, slot)}){x[0]}+")  # possessive: no way back, so matching stays linear
        elif x == "#":
            out.append(slot)
        else:
            out.append(chars.setdefault(x, chr(0xE000 + len(chars))) + ("?+" if x[0] == "=" else ""))
    return "".join(out)


def different(pages: list[Page]) -> list[Page]:
    """The pages less those of which another shows most of the text, in the order given."""
    taken: list[tuple[Page, Counter]] = []
    for page in pages:
        own: Counter[str] = Counter()
        for what, _, text in page.items:
            if what == TEXT:
                own[text_hash(text)] += len(text)
        mass = sum(own.values())
        if mass and all(sum((own & other).values()) <= COPIES * min(mass, sum(other.values())) for _, other in taken):
            taken.append((page, own))
    return [p for p, _ in taken]


def shared_texts(pages: list[Page]) -> set[str]:
    """Hashes of the texts that all pages show."""
    sets = [{text_hash(t) for what, _, t in p.items if what == TEXT} for p in pages]
    return set.intersection(*sets) if sets else set()


def main_element(page: Page, same: set[str]) -> int:
    """The element that holds the page's article, by the mass of the texts that are no template."""
    out = page.left_out
    mass = page.masses(same, out)
    best = 0
    for i in range(1, len(mass)):
        if not out[i] and page.tags[i] not in PROSE and mass[i] >= VARYING * mass[0] and page.parents[i] >= best:
            best = i
    up = best
    while up >= 0:
        if page.kinds[up] == "A":
            best = up
        up = page.parents[up]
    title = next((i for i, t in enumerate(page.tags) if t == "h1" and not out[i]), None)
    if title is not None:
        above = set()
        while title >= 0:
            above.add(title)
            title = page.parents[title]
        up = best
        while up not in above:
            up = page.parents[up]
        if page.tags[up] != "body" or page.tags[best] == "body":
            best = up if up > 0 else best
    return best


def infer(pages: list[Page], least_same: int = 6) -> str | None:
    """The wrapper of some pages of a host as JSON, or None if fewer than two differ."""
    pages = different([p for p in pages if len(p.items) <= ITEMS])
    if len(pages) < 2:
        return None
    same = shared_texts(pages)
    paths = Counter(json.dumps(p.path(main_element(p, same))) for p in pages)
    path = json.loads(min(paths, key=lambda x: (-paths[x], x)))
    if not path:
        return None
    items: list = []
    for p in pages:
        marks = collapse(skeleton(p, same)[0])
        items = align(items, marks) if items else marks
    texts = sorted(same) if len(pages) >= least_same else []
    found = {"path": path, "same": texts, "known": sorted(same), "marks": [], "regex": ""}
    best = 0
    mark = path[-1].rsplit(" ", 1)[0]
    for first, last in _spans(items, mark)[:8]:
        chars = {"#": chr(0xE000)}
        for h in found["known"]:
            chars["=" + h] = chr(0xE000 + len(chars))
        slot = "[" + "".join(chars.values()) + "]"
        parts = [_regex(x, chars, slot) for x in (items[:first], items[first : last + 1], items[last + 1 :])]
        tried = found | {"marks": list(chars), "regex": "{}({}){}".format(*parts)}
        wrapper = Wrapper(json.dumps(tried))
        right = sum(wrapper.matched(p) == main_element(p, same) for p in pages)
        if right > best:
            best, found = right, tried
    return json.dumps(found)


def _spans(items: list, mark: str) -> list[tuple[int, int]]:
    """Places of opens with that mark outside groups, and of their closes."""
    out = []
    for first, x in enumerate(items):
        if x != "<" + mark:
            continue
        depth = 0
        for last in range(first, len(items)):
            depth += (items[last] == "<" + mark) - (items[last] == ">" + mark)
            if not depth:
                out.append((first, last))
                break
    return out


class Wrapper:
    """A wrapper ready to be matched."""

    def __init__(self, written: str) -> None:
        found = json.loads(written)
        self.path, self.same, self.known = found["path"], set(found["same"]), set(found["known"])
        self.chars = {m: chr(0xE000 + i) for i, m in enumerate(found["marks"])}
        self.pattern = re.compile(found["regex"]) if found["regex"] else None

    def matched(self, page: Page) -> int | None:
        """The element in the place of the article, if the whole page fits."""
        if self.pattern is None:
            return None
        marks, nodes = skeleton(page, self.known)
        try:
            m = self.pattern.fullmatch("".join([self.chars[x] for x in marks]))
        except KeyError:
            return None
        return nodes[m.start(1)] if m else None

    def region(self, page: Page) -> int | None:
        """The article's element: as matched, else the first with the article's path."""
        at = self.matched(page)
        if at is None:
            at = page.at_path(self.path)
        return at


def _texts(page: Page, regions: set[int], same: set[str], out: list[bool]) -> list[str]:
    inside = page.within(regions)
    return [t for what, n, t in page.items if what == TEXT and inside[n] and not out[n] and not (same and page.tags[n] not in HEADINGS and text_hash(t) in same)]


def extract(html: str, wrapper: Wrapper | None = None) -> str:
    """The page's main text."""
    page = read(html)
    out = page.left_out
    marked = {k: {i for i, x in enumerate(page.kinds) if x == k and not out[i]} for k in "AMC"}
    at = wrapper.region(page) if wrapper else None
    if at is not None and not out[at]:
        got, inside = _texts(page, {at}, wrapper.same, out), page.within({at})
        for k in "AM":  # marked articles inside, if they hold most of it
            inner = {i for i in marked[k] if i != at and inside[i]}
            held = _texts(page, inner, wrapper.same, out) if inner else []
            if 2 * sum(map(len, held)) >= sum(map(len, got)) > 0:
                got = held
                break
        if got:
            return "\n".join(got)
    for k in "AMC":
        if marked[k] and (got := _texts(page, marked[k], set(), out)):
            return "\n".join(got)
    return "\n".join(_texts(page, {0}, set(), out))


def _compiled(wrapper: str | None, cache: dict) -> Wrapper | None:
    if not wrapper:
        return None
    if wrapper not in cache:
        if len(cache) > 5000:
            cache.clear()
        cache[wrapper] = Wrapper(wrapper)
    return cache[wrapper]


def _infer_batches(least_same: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [infer([read(h) for h in sorted(pages)], least_same) for pages in batch.column("pages").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "wrapper"])

    return batches


def host_of(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, sample_pages: int = 12, least_same: int = 6, max_bytes: int = 1 << 20) -> DataFrame:
    """host, wrapper: one row per host for which a wrapper could be inferred, from pages of at most ``max_bytes``."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    given = pages.select(host_of(pages["url"]).alias("host"), html.alias("html")).filter(F.octet_length("html") <= max_bytes).withColumn("draw", F.xxhash64("html"))
    order = Window.partitionBy("host").orderBy("draw")
    drawn = given.select("host", "draw").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_pages).select("host", "draw")
    drawn = cut(drawn)
    listed = F.broadcast(drawn) if drawn.count() <= 100_000 else drawn
    sample = given.join(listed, ["host", "draw"], "left_semi").groupBy("host", "draw").agg(F.min("html").alias("html"))
    return sample.groupBy("host").agg(F.collect_list("html").alias("pages")).mapInArrow(_infer_batches(least_same), "host string, wrapper string").filter("wrapper IS NOT NULL")


def extract_pages(pages: DataFrame, sample_pages: int = 12, least_same: int = 6, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars for every row. Wrappers are broadcast if their checked size allows, else joined by host."""
    found = cut(wrappers(pages, sample_pages, least_same))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    given = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"), host_of(pages["url"]).alias("host"))
    joined = given.join(F.broadcast(found) if size <= broadcast_bytes else found, "host", "left").select("page_id", "url", "html", "wrapper")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in it:
            texts = [extract(h, _compiled(w, cache)) for h, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"page_id {kind}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long")
