"""Main text of web pages by tree scoring.

Blocks of text (paragraphs, headings, list items) pass points for length and commas to their
ancestors, fewer the farther up, discounted by the share of text in links. The best container,
or the whole article or main element around it, is kept with those of its siblings that aren't
mostly links.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li dt dd td th blockquote figcaption caption summary".split())
#: Elements whose content is never text of the article.
DROPPED = frozenset("head title script style noscript template nav footer aside button select option textarea input iframe object embed svg math canvas audio video menu dialog map".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Words in class and id names, and roles, of what isn't the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: Words of blocks that within an article can be its own: its title and standfirst, and sections about these things.
HEADED = frozenset("header masthead".split())
TOPICS = frozenset("cookie cookies login search share sharing skip social signup subscribe subscription toolbar respond".split())
#: Words of headings over links that lead away from the article.
AWAY = frozenset("also categories latest more next popular previous read recent recommended related share tags topics trending".split())
CONTROLS = frozenset("button input select textarea".split())
#: Beside these a word of the above tells what stands around an element, as in has-sidebar or comments-open.
QUALIFIERS = frozenset("has have with without no not is open closed enabled disabled on off".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^'\">]*")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{9,});?")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# A block that starts closes an open paragraph; these close their own kind up to the list or table they are in.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _decoded(text: str) -> str:
    """The text with its character references decoded; numbers beyond all characters become replacement characters."""
    if "&" not in text:
        return text
    return unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub("&#", text)))


class Page:
    """Elements in page order (tag, parent, dropped, named like an aside) and blocks of text (element, text, share of links).

    A page is read once from left to right, and each step takes a time that doesn't grow with how
    deep the page is nested, so malformed pages take no longer than others of their length. A `<`
    that begins no tag is text; a tag whose quotes never close ends at the next `>`, as then do all
    tags after it, and a tag or comment without an end takes the rest of the page. Unknown end
    tags are passed over, and elements that stay open end with the page.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.dropped, self.named, self.own = ["#root"], [0], [False], [()], [False]
        self.blocks: list[tuple[int, str, float]] = []
        self._open, self._text, self._linked, self._in_link = [0], [], 0, 0
        self._depths: dict[str, list[int]] = {}  # by tag, where it stands among the open elements
        self._outer = [0]  # where those that aren't inline stand
        self._read(html)
        self.links, self.controls = [0] * len(self.tag), [0] * len(self.tag)
        for e in range(len(self.tag) - 1, 0, -1):
            self.links[self.parent[e]] += self.links[e] + (self.tag[e] == "a")
            self.controls[self.parent[e]] += self.controls[e] + (self.tag[e] in CONTROLS)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(_decoded("".join(self._text)).split())
            if text:
                self.blocks.append((self._open[self._outer[-1]], text, min(1.0, self._linked / len(text))))
        self._text, self._linked = [], 0

    def _close_to(self, depth: int) -> None:
        if self._outer[-1] >= depth:
            self._flush()
        while len(self._open) > depth:
            tag = self.tag[self._open.pop()]
            self._depths[tag].pop()
            self._in_link -= tag == "a"
        while self._outer[-1] >= depth:
            self._outer.pop()

    def _last(self, *tags: str) -> int:
        """Where the innermost open element of these stands; 0 if none is open."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag not in INLINE:
            own = self.tag[self._open[self._outer[-1]]]
            if own == "p" or own in HEADINGS and tag in HEADINGS:
                self._close_to(self._outer[-1])
            if tag in _CLOSES:
                kinds, until = _CLOSES[tag]
                around = self._last(*until)
                own = self._last("tr") if tag == "tr" else 0
                depth = own if own > around else self._last(*kinds)
                if depth > around:
                    self._close_to(depth)
            self._flush()
        up = self._open[-1]
        e = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        aside, named = self._is_aside(tag, attributes)
        # Whether a name tells the truth is only known with the whole page; text within a sentence goes at once.
        self.dropped.append(self.dropped[up] or aside or bool(named) and tag in INLINE)
        self.named.append(named)
        self.own.append(self.own[up] or tag in ("article", "main"))
        if tag not in VOID:
            self._depths.setdefault(tag, []).append(len(self._open))
            if tag not in INLINE:
                self._outer.append(len(self._open))
            self._open.append(e)
            self._in_link += tag == "a"

    def _is_aside(self, tag: str, attributes: str) -> tuple[bool, tuple[str, ...]]:
        """Whether an element is no text of the article, and those of its names that say so."""
        if tag in DROPPED:
            return True, ()
        if tag == "header":  # of the page; an article's own header holds its title
            return not self._last("article", "main"), ()
        form = ("form",) if tag == "form" else ()
        if not attributes.strip() or tag in ("html", "body", "article", "main"):
            return False, form
        given = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES or _HIDDEN.search(given.get("style", "")):
            return True, ()
        names = f"{given.get('class', '')} {given.get('id', '')}".split()
        return False, (*form, *[n for n in dict.fromkeys(names) if self._words(n) & ASIDE and not self._words(n) & QUALIFIERS])

    @staticmethod
    def _words(name: str) -> set[str]:
        return {w.lower() for w in _WORD.findall(name)}

    def kept(self) -> list[int]:
        """For each block: 0 to keep, 1 if it stands in a header by its name, 2 if in another aside.

        A name of which all elements together hold most of the page's prose is none of an aside, and
        neither is a form that does. In an article a section with a heading and prose, without
        controls and with few links, is a section of the article, if its name is only its topic.
        """
        n = len(self.tag)
        prose, chars, first, longest = [0.0] * n, [0] * n, [len(self.blocks)] * n, [0] * n
        for b, (owner, text, links) in enumerate(self.blocks):
            prose[owner] += len(text) * (1 - links)
            chars[owner] += len(text)
            first[owner] = min(first[owner], b)
            longest[owner] = max(longest[owner], 0 if self.tag[owner] in HEADINGS else len(text))
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            prose[up], chars[up] = prose[up] + prose[e], chars[up] + chars[e]
            first[up], longest[up] = min(first[up], first[e]), max(longest[up], longest[e])
        held: dict[str, float] = {}
        within: list[frozenset[str]] = [frozenset()] * n
        for e in range(1, n):
            within[e] = within[self.parent[e]]
            if self.named[e]:
                for name in self.named[e]:
                    if name not in within[e]:
                        held[name] = held.get(name, 0.0) + prose[e]
                if len(within[e]) < 50:
                    within[e] |= frozenset(self.named[e])
        out = [0] * n
        for e in range(1, n):
            out[e] = out[self.parent[e]]
            names = [x for x in self.named[e] if held[x] <= prose[0] / 2] if out[e] < 2 and self.named[e] else ()
            if names:
                words = set().union(*[self._words(x) & ASIDE or {x} for x in names])
                headed = first[e] < len(self.blocks) and self.tag[self.blocks[first[e]][0]] in HEADINGS
                if self.own[e] and words <= TOPICS and headed and longest[e] >= 80 and not self.controls[e] and prose[e] > 0.75 * chars[e]:
                    continue
                out[e] = max(out[e], 1 if words <= HEADED else 2)
        return [out[b[0]] for b in self.blocks]

    def _read(self, html: str) -> None:
        at, until, end = 0, 0, len(html)  # text begins at `at`; the next tag is sought from `until`
        quoted = True
        while at < end:
            begin = html.find("<", until)
            if begin < 0:
                self._piece(html[at:])
                break
            closing = html.startswith("/", begin + 1)
            name = _NAME.match(html, begin + 1 + closing)
            if name is None and not html.startswith(("!", "?", "/"), begin + 1):
                until = begin + 1
                continue
            self._piece(html[at:begin])
            if name is None:
                if html.startswith("<!--", begin):
                    stop = html.find("-->", begin + 4)
                    at = until = stop + 3 if stop >= 0 else end
                else:
                    at = until = html.find(">", begin) + 1 or end
                continue
            stop = self._tag_end(html, name.end()) if quoted else -1
            if stop < 0:
                quoted = False
                stop = html.find(">", name.end())
                if stop < 0:
                    break
            at = until = stop + 1
            tag = name[0].lower()
            if closing:
                depth = self._last(tag)
                if depth:
                    self._close_to(depth)
                continue
            attributes = html[name.end() : stop]
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?![^\\s/>])", re.I).search(html, at)
                stop = html.find(">", close.end()) if close else -1
                at = until = stop + 1 if stop >= 0 else end
                self._close_to(len(self._open) - 1)
        self._flush()

    def _piece(self, piece: str) -> None:
        if piece and not self.dropped[self._open[-1]]:
            self._text.append(piece)
            if self._in_link:
                self._linked += len(" ".join(_decoded(piece).split()))

    @staticmethod
    def _tag_end(html: str, at: int) -> int:
        """Where the tag's `>` outside quotes stands; -1 if there is none."""
        while True:
            at = _UNQUOTED.match(html, at).end()
            if at >= len(html):
                return -1
            if html[at] == ">":
                return at
            at = html.find(html[at], at + 1) + 1
            if not at:
                return -1


def main_text(html: str | None) -> str:
    """Blocks of the best container and of its siblings that are prose, joined by line feeds; empty if there is none."""
    if not isinstance(html, str) or not html:
        return ""
    page = Page(html)
    kinds = page.kept()
    blocks = [b for b, kind in zip(page.blocks, kinds) if kind == 0]
    if not blocks:
        return ""
    n = len(page.tag)
    points, chars, linked = [0.0] * n, [0] * n, [0.0] * n
    for owner, text, links in blocks:
        chars[owner] += len(text)
        linked[owner] += links * len(text)
    for e in range(n - 1, 0, -1):
        chars[page.parent[e]] += chars[e]
        linked[page.parent[e]] += linked[e]
    density = [b / a if a else 0.0 for a, b in zip(chars, linked)]
    # Lists that are nothing but links are menus; in an article those of long entries under a heading of their own are its sources.
    menu = [page.links[e] >= 3 and density[e] > 0.8 and page.tag[e] in ("ul", "ol", "dl", "table", "div", "section", "p") for e in range(n)]
    over = ""
    for owner, text, _ in blocks:
        if page.tag[owner] in HEADINGS:
            over = text
        listed = page.parent[owner] if page.tag[owner] in ("li", "dd", "dt") else 0
        if menu[listed] and page.own[listed] and over and not page._words(over) & AWAY and chars[listed] >= 30 * page.links[listed]:
            menu[listed] = False
        elif not menu[listed] and page.tag[owner] not in HEADINGS and not listed:
            over = ""
    for e in range(1, n):
        menu[e] = menu[e] or menu[page.parent[e]]
    blocks = [b for b in blocks if not menu[b[0]]]
    for owner, text, links in blocks:
        worth = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links)
        e, level = (page.parent[owner] if page.tag[owner] in PARAGRAPHS else owner), 0
        while True:
            points[e] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
            if e == 0 or level == 6:
                break
            e, level = page.parent[e], level + 1
    score = [p * (1 - d) + (25 if p and t in ("article", "main") else 0) for p, d, t in zip(points, density, page.tag)]
    best = max(range(n), key=lambda e: (score[e], -e))
    if page.tag[best] in ("ul", "ol", "dl", "tr", "tbody", "table"):  # a list or table belongs to what it stands in
        best = page.parent[best]
    # Of an article everything belongs; the outermost one, as comments can be articles within it.
    around, e = {}, best
    while e:
        if page.tag[e] in ("article", "main"):
            around[page.tag[e]] = e
        e = page.parent[e]
    best = around.get("article", around.get("main", best))
    keep = {best}
    for e in range(1, n):
        if best and page.parent[e] == page.parent[best] and (page.tag[e] in HEADINGS or chars[e] and density[e] < 0.25):
            keep.add(e)
    inside, chosen = [False] * n, [False] * n
    for e in range(n):
        inside[e] = e in keep or (e > 0 and inside[page.parent[e]])
        chosen[e] = e == best and page.tag[e] not in ("#root", "html", "body") or (e > 0 and chosen[page.parent[e]])
    # A header by its name within the chosen container is the article's own.
    own = {id(b) for b in blocks if inside[b[0]]} | {id(b) for b, kind in zip(page.blocks, kinds) if kind == 1 and chosen[b[0]] and not menu[b[0]]}
    return "\n".join(b[1] for b in page.blocks if id(b) in own)


def extract_html(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` without `html`, with the main text of each whole page.

    A null or empty page, or one without an article, has an empty text. White space in a block
    is one space; blocks come in page order, joined by line feeds. A column of `pages` named
    like `text` is replaced; repeated rows are extracted each.
    """
    passed = [c for c in pages.columns if c not in (html, text)]
    return map_batches(pages, passed, [html], [T.StructField(text, T.StringType())], lambda: lambda sources: [[main_text(x) for x in sources]])
