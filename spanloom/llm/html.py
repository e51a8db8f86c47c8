"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its start tags and its text nodes, each in the role that its path of
elements gives it. For every host, tokens with the same vector of occurrences over the host's pages
form an equivalence class. A vector is never built: sums of occurrences times hashes of the page
stand for it, so the classes of a host of any size come from one aggregation. Classes on at least
SUPPORT of the host's pages are checked for order and nesting, and the valid ones nest into the
host's template. An end tag is implied by the paths of what follows it.

The template cuts every page into slots: a text belongs to its innermost enclosing template element and,
inside that, to the gap after the template tag that came last. Each slot is measured over all pages of the
host (plain text, link text, distinct texts) and judged once for the host. Where slots stand in article or main
elements (which always cut), these slots are the content. Elsewhere the body is the deepest template element with more
than half of the host's plain text, and all slots are content but those of a branch beside the body that holds mostly links
(a menu) or texts that recur from page to page (notices, adverts). Text that is itself part of the template is not content outside article and main; inside them a
heading that every page repeats belongs to the article. Elements that say they are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments are left out of any slot, whether they stand on every page or on one.

A host with fewer than PAGES pages shows no classes; each of its pages is cut by its own elements, by the same rules.

Defined cases: a null or empty page gives an empty text; a null url is a host of its own; repeated rows
count as pages of their own; where all of a page's content would be template text (a host of nothing but copies),
the content stays; a page without main container on a host that has them, or the reverse, is cut by its own elements; an empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage

#: Pages of a host that a class needs, and its share of them.
PAGES, SUPPORT = 3, 0.5
#: Template and slot numbers (8 bytes each) up to which they are broadcast; beyond, pages are joined by host.
BROADCAST_TOKENS = 2_000_000

#: Names of elements, roles and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset(
    "head title nav header footer aside form script style noscript template iframe svg button select textarea object embed canvas audio video dialog menu "
    "noembed noframes xmp math datalist".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "header masthead comment comments disqus cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended widget pagination pager toolbar login signup search banner".split()
)
#: Words that may stand beside a boilerplate word in a name without giving it another meaning.
BESIDE = frozenset(
    "site page main top bottom left right upper lower global primary secondary sticky fixed inline bar box list area section wrapper wrap container block item items row "
    "link links inner outer post posts entry article thread form text message reader user google content slot unit panel buttons button icons".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag closes when they are open: itself or its siblings.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?:[!?]|/[^a-zA-Z])[^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

#: Marks of an element: boilerplate by its tag, by what it says of itself; main container; link; heading; header; element that may hold the body.
HARD, SOFT, MAIN, LINK, HEADING, HEADER, BOX = 1, 2, 4, 8, 16, 32, 64
TAG_MARKS = {
    **dict.fromkeys("html body div section center table tbody tr td".split(), BOX),
    **dict.fromkeys(BOILER, HARD), **dict.fromkeys(HEADINGS, HEADING), "article": MAIN, "main": MAIN, "a": LINK, "header": HARD | HEADER, "form": SOFT,
}
#: Kinds of template elements: a main container, one that may be the body.
CONTAINS, HOLDS = 2, 1
#: The element that stands around every page, and the token that every page has once.
ROOT = 0


def _says_boiler(value: str) -> int:
    """Marks by the names in a class or id: a name counts if it is made of boilerplate words and words that may stand beside them."""
    marks = 0
    for name in CAMEL.sub(r"\1-\2", value).lower().split():
        words = NAME.findall(name)
        hit = BOILER_WORDS.intersection(words)
        if hit and all(w in BOILER_WORDS or w in BESIDE for w in words):
            marks |= SOFT | (HEADER if hit <= {"header", "masthead"} else 0)
    return marks


def _marks(tag: str, attrs: str) -> tuple[str, int]:
    """(role of the element in a path, its marks)."""
    role, marks = tag, TAG_MARKS.get(tag, 0)
    if attrs and not attrs.isspace():
        for name, *values in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                if tag not in ("article", "main"):  # whose names often tell the page apart
                    role += "." + DIGITS.sub("0", value)
                if tag not in ("html", "body", "article", "main"):
                    marks |= _says_boiler(value)
            elif name == "role":
                marks |= (SOFT if value.lower() in BOILER_ROLES else 0) | (MAIN if value.lower() == "main" else 0)
            elif name == "itemprop" and value == "articleBody":
                marks |= MAIN
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                marks |= HARD
    return role, marks


def _hash(above: int, what: str) -> int:
    """Number of a token: the path above it and its own role or text, signed."""
    return xxhash.xxh64_intdigest(what.encode("utf-8", "surrogatepass"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Page:
    """Elements of a page (parent, path number, marks) and its nodes in order: (element, None) for a start tag, (element, text) for a text.

    ``kept`` tells of each element whether text in it may be content by what the elements around it say; ``block`` is the block of each node.
    """

    __slots__ = ("up", "path", "marks", "nodes", "block", "kept", "main", "link")

    def __init__(self, page: str):
        self.up, self.path, self.marks = [0], [ROOT], [0]
        self.nodes: list[tuple[int, str | None]] = []
        self.block: list[int] = []
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        up, path, marks, nodes, blocks = self.up, self.path, self.marks, self.nodes, self.block
        stack: list[tuple[str, int]] = [("", 0)]
        block, at, end, find = 0, 0, len(page), TAG.search
        while at < end:
            m = find(page, at)
            raw = page[at:] if m is None else page[at : m.start()]
            if raw:
                nodes.append((stack[-1][1], _html.unescape(raw) if "&" in raw else raw))
                blocks.append(block)
            if m is None:
                break
            at = m.end()
            closing, name, attrs = m.groups()
            if name is None:
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name == "br":
                nodes.append((stack[-1][1], " "))
                blocks.append(block)
                continue
            if name in VOID:
                continue
            if name in BLOCK and name not in ("html", "body"):
                closes = CLOSES.get(name, ())
                for i in range(len(stack) - 1, 0, -1):
                    tag = stack[i][0]
                    if tag == "p" or tag in closes:
                        del stack[i:]
                        break
                    if tag in BLOCK:
                        break
            role, mark = _marks(name, attrs)
            above = stack[-1][1]
            here = len(up)
            up.append(above)
            path.append(_hash(path[above], "<" + role))
            marks.append(mark)
            nodes.append((here, None))
            blocks.append(block)
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            elif not attrs.endswith("/"):
                stack.append((name, here))

    def _judge(self) -> None:
        """What the elements say: an element's own word does not count where it encloses every main container of the page."""
        up, marks = self.up, self.marks
        n = len(up)
        hard, mains = [False] * n, [0] * n
        for i in range(1, n):
            hard[i] = hard[up[i]] or marks[i] & HARD != 0
        for i in range(n - 1, 0, -1):
            mains[i] += marks[i] & MAIN != 0 and not hard[i]
            mains[up[i]] += mains[i]
        self.kept, self.main, self.link = [True] * n, [False] * n, [False] * n
        title = [0] * n  # 0 outside headers, 1 in a header of the main container, 2 in a heading there
        for i in range(1, n):
            above, m = up[i], marks[i]
            inside = self.main[above]
            soft = m & SOFT and not (mains[i] and mains[i] == mains[0])
            header = m & HEADER and inside
            title[i] = 1 if header else 2 if title[above] and m & HEADING else title[above]
            self.kept[i] = self.kept[above] and (header or not (m & HARD or soft)) != 0
            self.main[i] = inside or m & MAIN != 0
            self.link[i] = self.link[above] or m & LINK != 0
        self.kept = [k and t != 1 for k, t in zip(self.kept, title, strict=True)] if any(title) else self.kept

    def tokens(self) -> Iterator[tuple[int, bool]]:
        """(number, whether it is a tag) of every token in order."""
        for element, text in self.nodes:
            if text is None:
                yield self.path[element], True
            elif not text.isspace():
                yield text_number(self.path[element], text), False

    def slots(self, tags: frozenset[int] | set[int]) -> Iterator[tuple[int, int, int]]:
        """(place of the text among the nodes, its slot, its innermost template element's index) for every text that may be content."""
        inner = [0] * len(self.up)
        for i in range(1, len(self.up)):
            inner[i] = i if self.path[i] in tags or self.marks[i] & MAIN else inner[self.up[i]]
        last: dict[int, int] = {}
        for at, (element, text) in enumerate(self.nodes):
            e = inner[element]
            if text is None:
                if e == element:
                    last[inner[self.up[element]]] = self.path[element]
            elif self.kept[element] and not text.isspace():
                yield at, slot_number(self.path[e], last.get(e, 0)), e

    def chain(self, e: int, tags: frozenset[int] | set[int], once: frozenset[int] | set[int]) -> tuple[tuple[int, int], ...]:
        """(path, kind) of the template elements around ``e``, innermost first; ``once``: those of which a page has one."""
        out = []
        while e:
            path, mark = self.path[e], self.marks[e]
            if path in tags or mark & MAIN:
                out.append((path, CONTAINS if mark & MAIN else HOLDS if mark & BOX and path in once else 0))
            e = self.up[e]
        return (*out, (ROOT, 0))


def text_number(path: int, text: str) -> int:
    return _hash(path, " ".join(text.split()))


def slot_number(element: int, after: int) -> int:
    mixed = (element * 0x9E3779B97F4A7C15 + after * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return mixed - (1 << 63)


def judge(slots: Iterable[tuple], pages: int) -> tuple[bool, list[int]]:
    """(whether there are main containers, slots that are not content) from rows (slot, chain, plain, linked, texts, distinct).

    ``chain`` holds (path, kind) from the slot outwards; ``plain`` and ``linked`` are characters.
    """
    rows = list(slots)
    if any(kind == CONTAINS for r in rows for _, kind in r[1]):
        return True, [r[0] for r in rows if not any(kind == CONTAINS for _, kind in r[1])]
    total = sum(r[2] for r in rows)
    mass: dict[int, int] = {}
    around: dict[int, tuple] = {}
    for _, chain, plain, *_ in rows:
        for i, (path, kind) in enumerate(chain):
            if kind:
                mass[path] = mass.get(path, 0) + plain
                around[path] = chain[i:]
    body = max((p for p, m in mass.items() if 2 * m > total), key=lambda p: (len(around[p]), mass[p], p), default=ROOT)
    spine = {path for path, _ in around.get(body, ((ROOT, 0),))}
    branches: dict[tuple, list] = {}  # what stands beside the body, each with all its slots
    for slot, chain, plain, linked, texts, distinct in rows:
        if body == ROOT or not any(path == body for path, _ in chain):
            beside = next((path for path, _ in reversed(chain) if path not in spine), None)
            branch = branches.setdefault((beside, None if beside is not None else slot), [0, 0, 0, 0, []])
            for i, n in enumerate((plain, linked, texts, distinct)):
                branch[i] += n
            branch[4].append(slot)
    varied = max((r[5] / r[4] for r in rows if r[4]), default=0.0)
    out = []
    for plain, linked, texts, distinct, of in branches.values():
        if linked > plain or (pages >= PAGES and 2 * distinct < varied * texts):
            out += of
    return False, out


def _own_slots(page: Page) -> list[tuple]:
    """The slots of a page whose every element is a role of its own."""
    page.path = list(range(len(page.up)))
    tags = set(page.path[1:])
    held: dict[int, list] = {}
    for at, slot, e in page.slots(tags):
        element, text = page.nodes[at]
        row = held.get(slot) or held.setdefault(slot, [page.chain(e, tags, tags), 0, 0, 0, set()])
        row[1 + page.link[element]] += len(text.strip())
        row[3] += 1
        row[4].add(text)
    return [(slot, r[0], r[1], r[2], r[3], len(r[4])) for slot, r in held.items()]


def content(page: Page, tags: frozenset[int] | set[int], texts: frozenset[int] | set[int], mains: bool, dropped: frozenset[int] | set[int]) -> str:
    """The text of the page's content slots; ``tags``, ``texts``: the host's template, ``mains``, ``dropped``: its judged slots. Without tags the page's own stand in."""
    if not tags or mains != any(m & MAIN and k for m, k in zip(page.marks, page.kept, strict=True)):
        mains, out = judge(_own_slots(page), 1)
        tags, texts, dropped = set(page.path[1:]), frozenset(), set(out)

    def blocks(skip: frozenset[int] | set[int]) -> list[str]:
        shown: set[int] = set()
        for at, slot, _ in page.slots(tags):
            element, text = page.nodes[at]
            if slot not in dropped and not (skip and not page.main[element] and text_number(page.path[element], text) in skip):
                shown.add(at)
        out: dict[int, list[str]] = {}
        for at, (element, text) in enumerate(page.nodes):
            # white space between two texts of a block parts them
            if text is not None and (at in shown or (text.isspace() and page.kept[element])):
                out.setdefault(page.block[at], []).append(text)
        found = (" ".join("".join(parts).split()) for parts in out.values())
        return [t for t in found if t]

    found = blocks(texts)
    if not found and texts:
        found = blocks(frozenset())
    return "\n\n".join(found)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (host, token) of a batch: pages, occurrences, hash sums that stand for the vector, sum of places."""
    for b in slices(batches, "html"):
        sums: dict[tuple[int, int], list] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen: dict[int, list] = {ROOT: [1, 0, True]}
            for place, (key, tag) in enumerate(Page(page or "").tokens()):
                t = seen.get(key)
                if t is None:
                    seen[key] = [1, place, tag]
                else:
                    t[0] += 1
            own = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))
            one, two = own & 0x3FFFFFFF, (own >> 32) & 0x3FFFFFFF
            for key, (n, place, tag) in seen.items():
                s = sums.get((host, key))
                if s is None:
                    sums[host, key] = [1, n, n * one, n * two, place, tag]
                else:
                    s[0] += 1
                    s[1] += n
                    s[2] += n * one
                    s[3] += n * two
                    s[4] += place
        keys = np.array(list(sums), np.int64).reshape(-1, 2)
        values = np.array([v[:5] for v in sums.values()], np.int64).reshape(-1, 5)
        tags = [bool(v[5]) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, i]) for i in range(2)], *[pa.array(values[:, i]) for i in range(5)], pa.array(tags)], ["host", "token", "pages", "n", "one", "two", "place", "tag"])


def nest(classes: list[list[tuple[int, float, bool]]]) -> list[tuple[int, int, bool]]:
    """(token, class, tag) of the valid classes, largest support first: each lies within one gap of those above it.

    A class is a list of (token, mean place, tag). A class that interleaves with one that is already in the template is dropped.
    """
    valid: list[np.ndarray] = []
    out = []
    for number, members in enumerate(classes):
        places = np.array(sorted(p for _, p, _ in members))
        ok = True
        for other in valid:
            # nested either way: inside one gap of the other, or the other inside one gap of this
            if len(set(np.searchsorted(other, places).tolist())) > 1 and len(set(np.searchsorted(places, other).tolist())) > 1:
                ok = False
                break
        if ok:
            valid.append(places)
            out += [(t, number, tag) for t, _, tag in sorted(members, key=lambda m: m[1])]
    return out


def _templates(pdf: pd.DataFrame) -> pd.DataFrame:
    """All frequent classes of one host, to its template: tags, texts, and the tags of which a page has one."""
    groups = [g for _, g in sorted(pdf.groupby(["pages", "n", "one", "two"], sort=True), key=lambda kv: (-kv[0][0], -len(kv[1]), kv[0]))]
    classes = [[(int(t), float(p), bool(tag)) for t, p, tag in zip(g["token"], g["mean"], g["tag"], strict=True)] for g in groups]
    # a class needs a tag, so that it has a place in the page's structure; words that merely recur have none
    nested = nest([c for c in classes if any(tag for _, _, tag in c)])
    single = set(pdf["token"][pdf["n"] == pdf["pages"]].tolist())
    held = {tag: sorted(t for t, _, is_tag in nested if is_tag == tag) for tag in (True, False)}
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tags": [held[True]], "texts": [held[False]], "once": [sorted(set(held[True]) & single)]})


def host_of(url: Column) -> Column:
    """The host's number; null and odd addresses share one."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.xxhash64(name)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tags, texts, once): the template of each host with PAGES pages or more, as numbers of its tags and texts."""
    raw = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_tokens, "host long, token long, pages long, n long, one long, two long, place long, tag boolean")
    sums = raw.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "one", "two", "place")], F.first("tag").alias("tag")).where(F.col("pages") >= PAGES)
    sums = stage(sums, "html-tokens")
    totals = sums.where(F.col("token") == ROOT).select("host", F.col("pages").alias("total"))
    # at most 1 / SUPPORT times the tokens of a page are left for a host
    frequent = sums.where(F.col("token") != ROOT).join(totals, "host").where(F.col("pages") >= F.col("total") * SUPPORT)
    frequent = frequent.select("host", "token", "pages", "n", "one", "two", (F.col("place") / F.col("pages")).alias("mean"), "tag")
    return frequent.groupBy("host").applyInPandas(_templates, "host long, tags array<long>, texts array<long>, once array<long>")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html, tags, texts, once) to (host, slot, text, chain, kinds, plain, linked, n) for each text number of a slot in a batch."""
    names = ["host", "slot", "text", "chain", "kinds", "plain", "linked", "n"]
    for b in slices(batches, "html"):
        held: dict[tuple[int, int, int], list] = {}
        known: dict[int, tuple] = {}  # template of a host
        for host, html, tags, texts, once in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if host not in known:
                known[host] = frozenset(tags), frozenset(texts), frozenset(once)
            tags, texts, once = known[host]
            page = Page(html or "")
            chains: dict[int, tuple] = {}
            for at, slot, e in page.slots(tags):
                element, text = page.nodes[at]
                number = text_number(page.path[element], text)
                if number in texts:
                    continue
                row = held.get((host, slot, number))
                if row is None:
                    if e not in chains:
                        chains[e] = page.chain(e, tags, once)
                    row = held[host, slot, number] = [chains[e], 0, 0, 0]
                row[1 + page.link[element]] += len(text.strip())
                row[3] += 1
        keys, rows = list(held), list(held.values())
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [[p for p, _ in r[0]] for r in rows], [[m for _, m in r[0]] for r in rows], *([r[i] for r in rows] for i in (1, 2, 3))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The slots of one host, to its content element and the slots that are not content."""
    rows = [(int(r.slot), tuple(zip(map(int, r.chain), map(int, r.kinds), strict=True)), int(r.plain), int(r.linked), int(r.n), int(r.distinct)) for r in pdf.itertuples()]
    mains, dropped = judge(rows, PAGES)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "mains": [mains], "dropped": [sorted(dropped)]})


def _sized(df: DataFrame, columns: list[str]) -> DataFrame:
    """A staged table of templates, broadcast where its numbers are few."""
    size = df.agg(F.sum(sum((F.size(c) for c in columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_TOKENS else df


def judged_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, mains, dropped) by the slots that the templates ``found`` cut from all pages of their hosts."""
    cut = pages.select(host_of(F.col("url")).alias("host"), "html").join(_sized(found, ["tags", "texts", "once"]), "host").select("host", "html", "tags", "texts", "once")
    texts = cut.mapInArrow(_measured, "host long, slot long, text long, chain array<long>, kinds array<int>, plain long, linked long, n long")
    once = texts.groupBy("host", "slot", "text").agg(F.first("chain").alias("chain"), F.first("kinds").alias("kinds"), *[F.sum(c).alias(c) for c in ("plain", "linked", "n")])
    slots = once.groupBy("host", "slot").agg(
        F.first("chain").alias("chain"), F.first("kinds").alias("kinds"), *[F.sum(c).alias(c) for c in ("plain", "linked", "n")], F.count(F.lit(1)).alias("distinct")
    )
    return slots.groupBy("host").applyInPandas(_judged, "host long, mains boolean, dropped array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main text of every page."""
    found = stage(templates(pages), "html-templates")
    judged = judged_slots(pages, found)
    ready = stage(found.join(judged, "host", "left").select("host", "tags", "texts", F.coalesce("mains", F.lit(False)).alias("mains"), F.coalesce("dropped", F.array().cast("array<long>")).alias("dropped")), "html-slots")
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(_sized(ready, ["tags", "texts", "dropped"]), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            known: dict[int, tuple] = {}
            texts = []
            for host, html, tags, skip, mains, dropped in zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True):
                if host not in known:
                    known[host] = frozenset(tags or ()), frozenset(skip or ()), bool(mains), frozenset(dropped or ())
                texts.append(content(Page(html or ""), *known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    return joined.select("page_id", "url", "host", "html", "tags", "texts", "mains", "dropped").mapInArrow(run, schema)
