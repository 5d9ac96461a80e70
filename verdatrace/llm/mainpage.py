"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by
link density, length and stop-word density, and by the section they stand in
(menus, footers, sidebars, forms, adverts, notices and reader comments are bad
as a whole).  Short and otherwise ambiguous blocks stay open; the second pass
gives them the label of the nearest decided neighbour, first among those of the
same article or, without articles, of the same container.

Sections are told by elements and roles, and by the words of class and id, which
say less: what they mark is only a wrapper, and counts as no section, if an
article stands in it or most of the prose around it does.  Comments, hidden
parts, footers and asides stay sections whatever they hold.

Markup is read as browsers do where that matters: attributes one by one, tag
names whole, raw text to its own end tag, elements ended by what implies their
end.  All steps take time in proportion to the page.

Nulls, empties and the rest: null, empty and tagless pages give an empty text
or the text itself; unclosed and stray tags and any depth of nesting are put up
with; very long pages are taken whole; of two decided neighbours as near, one
good is enough within a container and both must be good across; an extraction
depends on its row alone, so repeated rows and null keys are harmless; other
columns pass through, but for those named like the results, which are replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from verdatrace.llm.common import map_arrow, texts_of, with_fields

#: Link density above which a block is bad.
MAX_LINKS = 0.5
#: Characters up to which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Stop-word densities: below LOW a block tells nothing good, from HIGH it is prose.
LOW, HIGH = 0.15, 0.25

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more
    no not of on one or our out she so some that the their them then there they this to up was we were what when which who will with you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist
    ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se
    ses son sont sur un une vous y
    al como con del desde donde el ella ellos en entre era es esta este esto ha hay la las lo los más me mi muy no nos o para pero por que se
    ser si sin sobre son su sus también te un una uno unos y ya
    """.split()
)
# Elements of HTML that break a line of text.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul
    """.split()
)
#: Elements that hold blocks together.
CONTAINERS = frozenset("article aside body div footer form header main nav section td".split())
# Elements whose content is no markup and ends at their own end tag.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements whose content is no text of the page.
SKIP_TAGS = frozenset("noscript template select datalist svg math object canvas audio video button".split())
#: Those of them that cannot hold blocks: a block's start ends them, unless their own end tag comes first.
INLINE_SKIP = frozenset("select datalist svg math button".split())
# Elements without content, which no tag closes.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element's start ends an open one of these, up to the nearest of those.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Sections that are no main text, by element, by ARIA role, and by words of class and id.
BAD_TAGS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "header": "header", "dialog": "notice", "fieldset": "form", "search": "form"}
BAD_ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "menu": "menu", "menubar": "menu"}
BAD_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager tabs toolbar topbar skip",
    "header": "header masthead sitehead",
    "footer": "footer copyright colophon legal",
    "aside": "sidebar aside related recommended recommendations widget widgets rail trending popular tags social share sharing",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay newsletter subscribe paywall disclaimer privacy",
    "ad": "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion promoted dfp",
    "comment": "comment comments commentlist respond replies reply disqus discussion",
    "form": "search searchbox login signup form",
}
_NAME = {word: kind for kind, words in BAD_NAMES.items() for word in words.split()}
#: Words after a section's word that leave it a section's name; and words before it that deny or only mention it.
_PARTS = frozenset("wrapper wrap container box block area list item items body content inner outer section bar banner slot unit link links panel text title row col column top bottom left right main thread group form".split())
_DENY = frozenset("has have with no without is not non hide show js open toggle".split())
#: Kinds that hold whatever stands in them; all others may be wrappers.
_FIRM = frozenset("footer aside comment hidden skip notice".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
_SKIP_EDGE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in INLINE_SKIP}
_WORD = re.compile(r"[^\W\d_]+")
_MAY_HIDE = re.compile("hidden|style", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of two alike the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def hidden(given: dict[str, str]) -> bool:
    """Whether an element with these attributes is not shown."""
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(given.get("style", "").lower()))


def named(value: str) -> str | None:
    """Kind of section that the words of a class or id name, if any."""
    for token in value.split():
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", token)]
        if not parts or parts[0] in _DENY:
            continue
        if parts[-1] in _NAME:
            return _NAME[parts[-1]]
        if parts[0] in _NAME and all(x in _PARTS or x.isdigit() for x in parts[1:]):
            return _NAME[parts[0]]
    return None


@dataclass
class Section:
    """A part of the page that may be no main text."""

    kind: str
    #: Whether it holds whatever stands in it, and whether an article in it makes it a mere wrapper.
    firm: bool
    loose: bool
    article: int
    above: Section | None
    holds_article: bool = False
    prose: int = 0
    #: Whether the part is no main text after all has been seen.
    bad: bool = True


@dataclass
class Block:
    text: str
    linked: int
    section: Section | None
    article: int
    container: int
    bad: bool = False


@dataclass
class _Open:
    """An open element, and what holds within."""

    tag: str
    section: Section | None
    article: int
    container: int


@dataclass
class Page:
    """Blocks of one page."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    stack: list[_Open] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)
    #: Open elements below an open link, or -1.
    link: int = -1
    #: Open elements below the outermost one whose content is skipped, or -1.
    skip: int = -1
    articles: int = 0
    containers: int = 0

    def read(self, html: str) -> list[Block]:
        at = 0
        while m := _TOKEN.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                tag = tag.lower()
                if m["close"]:
                    self.end(tag)
                elif tag in RAW_TAGS:
                    if tag in BLOCK_TAGS:
                        self.flush()
                    if not m["attrs"].endswith("/"):
                        found = _RAW_END[tag].search(html, at)
                        at = found.start() if found else len(html)
                else:
                    self.start(tag, m["attrs"], html, at)
            elif m[0].startswith("<![CDATA["):
                self.text(m[0][9:].removesuffix("]]>"), plain=True)
        self.text(html[at:])
        self.flush()
        return self.blocks

    def text(self, raw: str, plain: bool = False) -> None:
        if raw and self.skip < 0:
            made = raw if plain or "&" not in raw else unescape(raw)
            self.parts.append(made)
            if self.link >= 0:
                self.linked += len(made.strip())

    def flush(self) -> None:
        if self.parts:
            whole = " ".join("".join(self.parts).split())
            if whole:
                here = self.stack[-1] if self.stack else _Open("", None, 0, 0)
                self.blocks.append(Block(whole, self.linked, here.section, here.article, here.container))
            self.parts = []
        self.linked = 0

    def close(self, size: int) -> None:
        """End the open elements from number ``size`` on."""
        for x in self.stack[size:]:
            self.counts[x.tag] -= 1
        del self.stack[size:]
        self.link = self.link if self.link <= size else -1
        self.skip = self.skip if self.skip < size else -1

    def last(self, tags: set[str], until: set[str] = frozenset()) -> int:
        """Number of the innermost open element of ``tags`` that is not beyond one of ``until``, or -1."""
        if any(self.counts[t] > 0 for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in tags:
                    return k
                if self.stack[k].tag in until:
                    break
        return -1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
        if self.counts[tag] > 0:
            k = self.last({tag})
            # An inline element that overlaps blocks ends alone.
            if tag in BLOCK_TAGS or tag in SKIP_TAGS or not any(x.tag in BLOCK_TAGS for x in self.stack[k + 1 :]):
                self.close(k)

    def start(self, tag: str, raw: str, html: str, at: int) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in BLOCK_TAGS
        if block:
            self.flush()
            if self.skip >= 0 and self.stack[self.skip].tag in INLINE_SKIP and not self.stack[self.skip].container:
                self.close(self.skip)  # never closed, and no place for a block
            if (k := self.last({"p"}, {"td", "th", "button", "object"})) >= 0 and tag not in ("option", "optgroup"):
                self.close(k)
        if tag in IMPLIED_ENDS and (k := self.last(*IMPLIED_ENDS[tag])) >= 0:
            self.close(k)
        if tag in VOID_TAGS or raw.endswith("/") and not block and tag not in SKIP_TAGS:
            return
        if tag == "a":
            self.link = len(self.stack)
        here = self.stack[-1] if self.stack else _Open("", None, 0, 0)
        section, article, container = here.section, here.article, here.container
        if self.skip >= 0:
            # Only what ends it matters here.
            self.push(_Open(tag, section, article, container))
            return
        if tag in SKIP_TAGS:
            if raw.endswith("/"):
                return
            # In place of a container it tells whether the element is closed before another of its kind begins.
            edge = _SKIP_EDGE[tag].search(html, at) if tag in INLINE_SKIP else None
            self.skip = len(self.stack)
            self.push(_Open(tag, section, article, int(bool(edge and edge[1])) if tag in INLINE_SKIP else container))
            return
        if not block:
            # Within a line only what is hidden matters; it takes no part in the block and does not break it.
            if raw and _MAY_HIDE.search(raw) and hidden(attributes(raw)):
                self.skip = len(self.stack)
                self.push(_Open(tag, section, article, container))
            return
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        own = self.section(tag, attributes(raw) if raw else {}, section, article)
        if tag in ("article", "main") and own is None:
            above = section
            # An article is no part of what is merely wrapped around it or was never closed.
            while above and not above.firm:
                above.holds_article, above = True, above.above
            if above is None:
                section = None
                self.articles += 1
                article = self.articles
        self.push(_Open(tag, own or section, article, container))

    def push(self, x: _Open) -> None:
        self.stack.append(x)
        self.counts[x.tag] += 1

    def section(self, tag: str, given: dict[str, str], above: Section | None, article: int) -> Section | None:
        """The section that a tag opens, if any."""
        if hidden(given):
            return Section("hidden", True, False, article, above)
        kind, told = BAD_TAGS.get(tag), True
        if not kind:
            kind = BAD_ROLES.get(given.get("role", "").strip().lower())
        if not kind and tag not in ("html", "body"):
            kind, told = named(given.get("class", "")) or named(given.get("id", "")), False
            if tag in ("article", "main") and kind != "comment":
                kind = None
        if not kind or kind == "header" and article:  # an article's own header holds its headline
            return None
        # Class and id only hint, but for comments; whole pages stand in forms, and in headers and menus that were never closed.
        return Section(kind, kind in _FIRM and (told or kind == "comment"), not told or kind == "form", article, above)


def prose(text: str) -> float:
    """Stop-word density."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def mark(blocks: list[Block], densities: list[float]) -> None:
    """Decide which sections are bad, and with them the blocks in them.

    What is not firm is a wrapper if an article stands in it, or if more than
    half of the prose of its article (without articles: of the page) does.
    """
    linked = [b.linked > MAX_LINKS * len(b.text) for b in blocks]
    good = [not x and (d >= HIGH and len(b.text) > SHORT or d >= LOW and len(b.text) >= LONG) for b, d, x in zip(blocks, densities, linked, strict=True)]
    if not any(good):  # no language that is known here: length has to tell
        good = [not x and len(b.text) > SHORT for b, x in zip(blocks, linked, strict=True)]
    whole: Counter = Counter()
    firm: dict[int, bool] = {}

    def is_firm(s: Section | None) -> bool:
        """Whether a section stands in, or is, a firm one."""
        chain = []
        while s is not None and id(s) not in firm:
            chain.append(s)
            s = s.above
        known = firm[id(s)] if s is not None else False
        for x in reversed(chain):
            known = firm[id(x)] = known or x.firm
        return known

    # Inner sections come after outer ones in the page, so sums are handed outwards from the last on.
    sections: dict[int, Section] = {}
    for b, g in zip(blocks, good, strict=True):
        s = b.section
        while s is not None and id(s) not in sections:
            sections[id(s)] = s
            s = s.above
        if g and not is_firm(b.section):
            whole[b.article] += len(b.text)
            if b.section:
                b.section.prose += len(b.text)
    depth: dict[int, int] = {}
    for s in sections.values():
        chain = []
        x: Section | None = s
        while x is not None and id(x) not in depth:
            chain.append(x)
            x = x.above
        base = depth[id(x)] if x is not None else 0
        for k, x in enumerate(reversed(chain), 1):
            depth[id(x)] = base + k
    order = sorted(sections.values(), key=lambda s: depth[id(s)])
    for s in reversed(order):
        if s.above is not None and s.above.article == s.article:
            s.above.prose += s.prose
    articles = any(b.article and not is_firm(b.section) for b in blocks)
    for s in order:
        wraps = s.holds_article and s.loose or 2 * s.prose > whole[s.article] and (s.article or not articles)
        s.bad = s.firm or not wraps or s.above is not None and s.above.bad and s.above.firm
    for s in order:  # from the outside in
        s.bad = s.bad or s.above is not None and s.above.bad
    for b in blocks:
        b.bad = b.section is not None and b.section.bad


def decide(blocks: list[Block], densities: list[float]) -> list[bool | None]:
    """First pass: good, bad, or open."""
    out: list[bool | None] = []
    for b, density in zip(blocks, densities, strict=True):
        n = len(b.text)
        if b.bad or b.linked > MAX_LINKS * n:
            out.append(False)
        elif n <= SHORT:
            out.append(None)
        elif density >= HIGH or (density >= LOW and n >= LONG):
            out.append(True)
        else:
            out.append(None if density >= LOW or b.article else False)
    return out


def inherit(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Second pass: open blocks get the label of the nearest decided neighbour.

    Inside an article only links are bad and prose stands between them, so an
    open block is bad only between two bad ones.  Elsewhere neighbours in
    the same container come first, and one good of two as near is enough there;
    across containers both must be good.  A page without any decided block is
    taken whole.
    """
    size = len(blocks)
    # For each open block the nearest decided one before and after it: in its article, in its container, anywhere.
    near: list[list[list[int | None]]] = [[[None] * size for _ in range(3)] for _ in range(2)]
    for side, run in enumerate((range(size), range(size - 1, -1, -1))):
        article: dict[int, int] = {}
        container: dict[int, int] = {}
        last = None
        for k in run:
            b = blocks[k]
            if labels[k] is None:
                near[side][0][k], near[side][1][k], near[side][2][k] = article.get(b.article), container.get(b.container), last
            else:
                last = container[b.container] = k
                if not b.bad:
                    article[b.article] = k
    out = []
    for k, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            of = [[x for x in (near[0][how][k], near[1][how][k]) if x is not None] for how in range(3)]
            nearest = [[labels[x] for x in found if abs(x - k) == min(abs(y - k) for y in found)] for found in of]
            if b.article:
                label = len(of[0]) < 2 or any(labels[x] for x in of[0])
            elif of[1]:
                label = any(nearest[1])
            else:
                label = all(nearest[2])
        out.append(bool(label))
    return out


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    densities = [prose(b.text) for b in blocks]
    mark(blocks, densities)
    return inherit(blocks, decide(blocks, densities))


def extract(html: str | None) -> str:
    """Main text of a page: its good blocks in order, one a line."""
    if not html:
        return ""
    blocks = Page().read(html)
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks), strict=True) if good)


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by its main text as column ``out``, and ``n_chars``, its code points."""
    place = pages.columns.index(html)
    keep = [c for c in pages.columns if c not in (html, out, "n_chars")]
    schema = with_fields(pages.select(*keep), f"{out} string, n_chars bigint")
    rest = [pages.columns.index(c) for c in keep]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [extract(x) for x in texts_of(batch.column(place))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=schema.names)

    return map_arrow(pages, run, schema)
