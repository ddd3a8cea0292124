"""Main text of HTML pages by tree scoring.

A page is cut into tags and text, a tree of containers is built, and every block
of text (paragraph, heading, list item, cell, or text that stands in a container
itself) passes points to its ancestors: one, one for each comma, and one for
each hundred characters up to three, halved from the container to the one around
it and on. Points are discounted by the container's link density. The best
container is kept, and in page order what else belongs to it: beside an article or
main element the siblings that score well, else all parts beside it or beside the
containers around it that read as prose, short or long, and have few links. Parts that are never content (menus, headers,
footers, sidebars, notices, adverts, forms, comments of readers, scripts, styles)
are left out by element, role, class or id before scoring. A form goes unless most
of the page's prose lies in it, a field set without prose goes, a button's text stays
in a sentence. Articles of one main belong together; of articles within an article
teasers and those under a heading of comments go. The id of a heading, a paragraph
or an item is an anchor and counts for nothing, and a name that a section of an
article may have as its topic only where the section has no prose or many links. A
class or id else only counts where it agrees with the text: a name within a longer token ("my-widget-x")
takes out parts with little prose or many links, and a name that may mean content
does not count where the parts that have it hold most of the page's prose.

Inside a block, inline elements join without a break, character references are
decoded and white space becomes one space. Blocks are joined by a newline. An
unwanted inline element leaves its paragraph in one piece.

Broken markup is fine: elements that are never closed end with their parent, a
block element ends an open paragraph, body or what can not stand in a head ends an
open head, unknown end tags are ignored, a "<" that begins no tag is text. A
quoted value ends at its quote; a quote that is never closed, or closed where no
attribute ends, ends with its tag. A link may hold blocks; one that is never
closed ends with its block. Time is linear in the page: sums go up the tree once,
and no step walks over what is open. There is no recursion.

Edge cases: null, empty, blank or text-free pages give "". A page without any
container is scored as one. Of equal scores the first container wins. Where
everything is named as no content, the least suspect parts are kept. Very long
pages take some hundred bytes for each tag. Repeated rows give repeated results;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from symbolake.llm.base import small_batches
from symbolake.llm.textkernel import valid

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|<", re.S)
#: The attributes of a tag and its end.
REST = re.compile(r"""([^>=]*+(?:=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+[^>=]*+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
#: Where the next link begins or ends.
LINK_EDGE = re.compile(r"<(/?)a(?=[\s/>])", re.I)
#: Elements whose content is no markup; and those left out with all that they hold.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
HOLLOW = {"template", "noscript", "svg", "object", "select", "canvas", "audio", "video", "datalist", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "blockquote", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "article", "main", "body", "html", "head", "aside", "nav", "header", "footer", "form", "fieldset", "dialog", "menu", "center"}
#: Blocks that hold text and no other block of their kind; all other blocks may be containers.
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "pre", "figcaption", "caption", "summary"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUT = {"nav", "aside", "footer", "dialog", "menu", "head", *HOLLOW}
#: Parts that are judged by what they hold: a form goes unless most of the page's prose is in it, a field set without prose goes, a button goes unless it stands in a sentence.
JUDGED = {"form", "fieldset", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Names of parts that are never content, and of parts that may be.
FIRM = r"ads?|advert[a-z0-9]*|adsense|nav|navbar|navbox|navigation|noprint|editsection|sharedaddy|addtoany|menu[a-z0-9]*|breadcrumbs?|sidebar[a-z0-9]*|footer|masthead|site-?header|page-?header|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|newsletter|pager|pagination|skip-?link|login|search-?(?:form|box)"
LOOSE = r"banner|promo[a-z0-9]*|sponsor[a-z0-9]*|notice|notification|popup|modal|overlay|subscribe|signup|share|sharing|social|related|recommend[a-z0-9]*|widget|toolbar"
NAMES = re.compile(rf"(?:^|[\s_-])({FIRM}|{LOOSE})(?=$|[\s_-])", re.I)
IS_FIRM = re.compile(FIRM, re.I)
#: Names that a section of an article may have as its topic.
TOPIC = re.compile(r"nav|navbar|navigation|menu[a-z0-9]*|breadcrumbs?|cookies?|consent|login|pager|pagination|notice|notification|overlay|toolbar", re.I)
#: A heading over the comments of readers.
COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user|visitor)s?['’]?s?\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\W*(?:\(?\d+\)?\W*)?", re.I)
#: Words that may stand beside a name without changing what it says.
LAYOUT = r"all|area|articles?|bar|block|blog|body|bottom|box|buttons?|col|column|component|container|content|custom|enabled|entry|fb|form|global|group|header|icons?|inner|items?|js|label|latest|left|links?|list|main|media|mobile|module|more|my|new|news|outer|page|panel|posts?|primary|readers?|recent|right|rail|row|secondary|section|single|site|slot|stories|story|text|thread|title|top|unit|users?|visitors?|wrap|wrapper|\d+(?:x\d+)?"
#: Atomic, so that no token takes more than one try.
WHOLE = re.compile(rf"(?>(?:[_-]*(?>(?:{FIRM}|{LOOSE}|{LAYOUT})(?=[_-]|$)))+)[_-]*", re.I)
#: Names of parts that stay out even where nothing else is left.
NEVER = re.compile(r"ad|cookie|consent|gdpr|login", re.I)
#: Class names that say what a container has, not what it is: "with-sidebar".
HAS = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-][\w-]+", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What may stand in a head; anything else, and text, ends it.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: What an opening tag closes when it is open within the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Share of link text up to which a part beside the best container is prose.
LINKED = 0.3


class Node:
    """A block element, or an inline element that is left out or has a telling name."""

    __slots__ = ("name", "parent", "out", "word", "kind", "up", "outer", "firm", "article", "depth", "inline", "within", "score", "chars", "links", "prose", "gone", "hard", "kept", "order")

    def __init__(self, name: str, parent: Node | None, out: bool, word: str = "", kind: str = ""):
        self.name, self.parent, self.out = name, parent, out
        #: What its class or id calls it, and how surely; ``up`` is the nearest node with a name above, ``outer`` whether none above has the same.
        self.word, self.kind = word, kind
        self.up = (parent if parent.word else parent.up) if parent else None
        self.outer = True
        self.firm = (self.up.firm if self.up else 0) + ((math.inf if NEVER.match(word) else 1) if kind == "firm" else 0)
        self.article = bool(parent and parent.article) or name in ("article", "main")
        self.depth = parent.depth + 1 if parent else 0
        #: Open inline elements, kept from the first that tells on, and how many of each name.
        self.inline: list[Node] = []
        self.within: dict[str, int] = {}
        self.score = 0.0
        self.chars = self.links = self.prose = 0
        self.gone = self.hard = self.kept = False
        self.order = 0


def _unwanted(name: str, attributes: str, inside_article: bool) -> tuple[bool, str, str]:
    """Whether a part is never content; else the name its class or id gives it, and the kind of that name."""
    if name in OUT or (name == "header" and not inside_article):
        return True, "", ""
    if name in ("html", "body", "article", "main"):
        return False, "", ""
    if not TELLING.search(attributes):
        return False, *((name, name) if name in JUDGED else ("", ""))
    word, kind = (name, name) if name in JUDGED else ("", "")
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            return True, "", ""
        if key == "role" and value.lower() in ROLES:
            return True, "", ""
        # an id is an anchor as well as a name: of headings and paragraphs it says what they are about
        if key == "id" and name in LEAF:
            continue
        if key in ("class", "id") and kind != "firm" and NAMES.search(value := HAS.sub("", value)):
            for token in value.split():
                found = [x.lower() for x in NAMES.findall(token)]
                sure = [x for x in found if IS_FIRM.fullmatch(x)]
                sort = "part" if not WHOLE.fullmatch(token) else "firm" if sure else "loose"
                if name == "section" and inside_article and TOPIC.fullmatch(token):
                    sort = "topic"
                if found and (kind in ("", "part", *JUDGED) or sort == "firm"):
                    word, kind = (sure or found)[0], sort
    return False, word, kind


def _prose(value: str, linked: int) -> bool:
    return 3 * linked <= len(value) and (len(value) > 40 or value.endswith((".", "!", "?", "。", "！", "？", "…")))


def _stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """First and end of each stretch of true values."""
    edges = [i for i in range(len(flags) + 1) if (i < len(flags) and flags[i]) != (i > 0 and flags[i - 1])]
    return list(zip(edges[::2], edges[1::2], strict=True))


class _Page:
    def __init__(self):
        self.root = Node("", None, False)
        self.nodes = [self.root]
        self.open = [self.root]  # blocks
        self.within: dict[str, int] = {}  # open blocks by name
        self.named: dict[tuple[str, str], int] = {}  # open nodes by name and kind
        #: Texts of the open block: the node that holds each (for its name), the text, and characters inside links.
        self.pieces: list[tuple[Node, str, int]] = []
        self.link = 0  # 1: until its end tag; 2: until the block ends
        self.blocks: list[tuple[Node, list[tuple[Node, str, int]]]] = []

    @property
    def at(self) -> Node:
        """The innermost open element that matters."""
        block = self.open[-1]
        return block.inline[-1] if block.inline else block

    def text(self, value: str) -> None:
        if self.open[-1].name == "head" and value.strip():
            self.close(len(self.open) - 1)
        at = self.at
        if not at.out:
            self.pieces.append((at, value, len(value.strip()) if self.link else 0))

    def flush(self) -> None:
        """The open block ends."""
        if self.link == 2:
            self.link = 0
        if any(not value.isspace() for _, value, _ in self.pieces):
            self.blocks.append((self.open[-1], self.pieces))
        self.pieces = []

    def begin(self, name: str, out: bool, word: str, kind: str) -> Node:
        node = Node(name, self.at, out, word, kind)
        node.order = len(self.nodes)
        self.nodes.append(node)
        if word:
            node.outer = not self.named.get((word, kind))
            self.named[word, kind] = self.named.get((word, kind), 0) + 1
        return node

    def block(self, name: str, out: bool, word: str, kind: str) -> None:
        self.open.append(self.begin(name, out, word, kind))
        self.within[name] = self.within.get(name, 0) + 1

    def span(self, name: str, out: bool, word: str, kind: str) -> None:
        """An inline element that tells, or lies in one."""
        block = self.open[-1]
        if word or block.inline or out and not block.out:
            block.inline.append(self.begin(name, out, word, kind))
            block.within[name] = block.within.get(name, 0) + 1

    def end_span(self, name: str) -> None:
        block = self.open[-1]
        if block.within.get(name):
            while True:
                node = block.inline.pop()
                block.within[node.name] -= 1
                self.unname(node)
                if node.name == name:
                    break

    def unname(self, node: Node) -> None:
        if node.word:
            self.named[node.word, node.kind] -= 1

    def close(self, until: int) -> None:
        self.flush()
        for node in self.open[until:]:
            self.within[node.name] -= 1
            for x in (node, *node.inline):
                self.unname(x)
        del self.open[until:]

    def end_block(self, name: str) -> None:
        if self.within.get(name):
            k = len(self.open) - 1
            while self.open[k].name != name:
                k -= 1
            self.close(k)

    def drop_named(self) -> None:
        """Leave out the texts of parts that their names and their text show to be no content.

        A name that is a whole token takes its part out; one that never means
        content does unless all prose lies within such parts (then the outermost
        stay), one that may mean content does unless the parts of that name hold
        most of the prose. A name that is a piece of a token takes out parts that
        are mostly links, with the same exception. Where nothing would be left,
        all stays.
        """
        every = []
        for block, pieces in self.blocks:
            for at, value, linked in pieces:
                own = at if at.word else at.up
                plain = " ".join(value.split())
                every.append((own, len(plain), linked, len(plain) if block.name not in HEADING and _prose(plain, linked) else 0))
        firm = [own.firm if own else 0 for own, _, _, _ in every]
        least = min((n for n, x in zip(firm, every, strict=True) if x[3] and n < math.inf), default=0)
        keep, total = [n <= least for n in firm], 0
        for (own, chars, linked, prose), stays in zip(every, keep, strict=True):
            if stays:
                total += prose
                if own:
                    own.chars, own.links, own.prose = own.chars + chars, own.links + linked, own.prose + prose
        named, of_name = [x for x in self.nodes if x.word], {}
        for x in reversed(named):
            if x.up:
                x.up.chars, x.up.links, x.up.prose = x.up.chars + x.chars, x.up.links + x.links, x.up.prose + x.prose
            if x.outer:
                of_name[x.word, x.kind] = of_name.get((x.word, x.kind), 0) + x.prose
        for x in named:
            if x.kind in ("form", "fieldset", "topic"):
                x.gone = not x.prose or 2 * x.links > x.chars or (x.kind == "form" and 2 * x.prose <= total)
                x.hard = x.kind != "topic" and not x.prose
            elif x.kind not in ("firm", "button") and 2 * of_name[x.word, x.kind] <= total:
                x.gone = x.kind == "loose" or 2 * x.links > x.chars
            x.gone, x.hard = x.gone or bool(x.up and x.up.gone), x.hard or bool(x.up and x.up.hard)
        fine = [stays and not (x[0] and x[0].gone) for x, stays in zip(every, keep, strict=True)]
        if not any(f and x[1] for f, x in zip(fine, every, strict=True)):
            fine = [stays and not (x[0] and x[0].hard) for x, stays in zip(every, keep, strict=True)]
        at = 0
        for block, pieces in self.blocks:
            button = [bool(x[0] and x[0].kind == "button") for x in every[at : at + len(pieces)]]
            if any(button):
                for i, j in _stretches(button):  # a button's text is a word of the sentence that it stands in
                    before, after = (pieces[i - 1][1] if i else "")[-1:], (pieces[j][1] if j < len(pieces) else "")[:1]
                    if block.name not in LEAF or not before.isspace() or not (after.isspace() or after in (".", ",", ";", ":", "!", "?", ")")):
                        fine[at + i : at + j] = [False] * (j - i)
            at += len(pieces)
        k = iter(fine)
        self.texts: list[tuple[Node, str, int]] = []
        for block, pieces in self.blocks:
            some = [x for x in pieces if next(k)]
            if value := " ".join("".join(x[1] for x in some).split()):
                self.texts.append((block, value, min(sum(x[2] for x in some), len(value))))

    def score(self) -> None:
        for x in self.nodes:
            x.chars = x.links = 0
        for at, value, linked in self.texts:
            holder = _holder(at)
            points = 0.5 if at.name in HEADING else 1 + value.count(",") + value.count("，") + min(len(value) // 100, 3)
            holder.chars, holder.links, holder.score = holder.chars + len(value), holder.links + linked, holder.score + points
        for x in reversed(self.nodes):  # those inside come after
            if x.parent:
                x.parent.chars, x.parent.links, x.parent.score = x.parent.chars + x.chars, x.parent.links + x.links, x.parent.score + x.score / 2


def _holder(at: Node) -> Node:
    """The container of a block."""
    return at.parent if at.name in LEAF and at.parent else at


def parse(source: str) -> _Page:
    page, at, n, endless = _Page(), 0, len(source), set()
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            page.text(entities.unescape(source[at:]))
            break
        if m.start() > at:
            page.text(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0] == "<":
                page.text("<")
            continue
        name, rest = m[2].lower(), REST.match(source, at)
        if not rest:
            break  # the page ends in a tag
        at = rest.end()
        if m[1]:
            if name == "a":
                page.link = 0
            elif name in BLOCK:
                page.end_block(name)
            page.end_span(name)
            continue
        attributes = rest[1]
        if page.open[-1].name == "head" and name not in IN_HEAD:
            page.close(len(page.open) - 1)
        if name in RAW:
            end = None if name in endless else RAW_END[name].search(source, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                break
            else:
                endless.add(name)  # without an end what follows is read as usual
            continue
        if name == "br":
            page.text(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name == "a":
            edge = LINK_EDGE.search(source, at)
            page.link = 0 if not HREF.search(attributes) else 1 if edge and edge[1] else 2
        out, word, kind = page.at.out, "", ""
        if not out:
            out, word, kind = _unwanted(name, attributes, page.open[-1].article)
        if name not in BLOCK:
            if not (attributes.endswith("/") and (name in HOLLOW)):
                page.span(name, out, word, kind)
            continue
        page.flush()
        if name == "hr":
            continue
        # a paragraph or heading never holds a block; items and cells end their like
        while page.open[-1].name == "p" or page.open[-1].name in HEADING or page.open[-1].name in CLOSES.get(name, ()):
            page.close(len(page.open) - 1)
        page.block(name, out, word, kind)
    page.flush()
    page.drop_named()
    page.score()
    return page


def _discounted(node: Node) -> float:
    return node.score * (1 - node.links / node.chars) if node.chars else 0.0


def _readable(page: _Page) -> tuple[set[int], set[int]]:
    """Nodes that hold prose somewhere, and those that hold headings of which every one is a link (teasers)."""
    prose, linked, plain = set(), set(), set()
    for at, value, links in page.texts:
        kind = prose if at.name not in HEADING and _prose(value, links) else linked if at.name in HEADING and 2 * links > len(value) else plain if at.name in HEADING else None
        node = at if kind is not None else None
        while node is not None and id(node) not in kind:
            kind.add(id(node))
            node = node.parent
    return prose, linked - plain


def _parts(best: Node, page: _Page, holders: dict[int, Node], beside: set[int]) -> set[int]:
    """Other parts of the article: what stands beside the best container, or around it, and reads as prose.

    Length does not matter, only links do; a teaser, whose headings are links, is
    no part of an article that has other headings. Beside containers around the
    best one other parts count up to the body, whose other children must be
    sections. Beside an article or main only what stands next to it counts.
    """
    prose, teasers = _readable(page)
    inside: dict[int, list[Node]] = {}
    for x in holders.values():
        if x.parent is not None:
            inside.setdefault(id(x.parent), []).append(x)
    keep, node, marked = set(), best, best.name in ("article", "main")
    while node.parent is not None:
        at_top = node.parent.name in ("", "html", "body")
        if not at_top:
            beside.add(id(node.parent))
        for x in inside[id(node.parent)]:
            near = node is best or not at_top
            text = x.name == "section" and not marked or id(x) in prose and near
            if x is not node and text and x.links <= LINKED * x.chars and not (id(x) in teasers and id(best) not in teasers):
                keep.add(id(x))
        if at_top or marked:
            break
        node = node.parent
    return keep


def _article_of(node: Node | None) -> Node | None:
    """The nearest article or main around a node, itself included."""
    while node is not None and node.name not in ("article", "main"):
        node = node.parent
    return node


def _articles(best: Node, page: _Page, holders: dict[int, Node]) -> tuple[set[int], set[int], set[int]]:
    """Beside a best article or main: further articles that are kept, parts inside it that go, and texts (by place) that go.

    Articles of one main belong together, wrapped or not, unless they are teasers or
    mostly links. Of articles within the best container teasers go, and so do, with
    the part around them, those under a heading that says they are comments.
    """
    prose, teasers = _readable(page)
    keep, gone, silent = set(), set(), set()
    own = [x for x in page.nodes if x.name == "article" and x is not best and id(x) in holders]
    main = _article_of(best.parent)
    inside = {id(best)}  # all that lies in the best container, in page order
    for x in page.nodes:
        if x.parent is not None and id(x.parent) in inside:
            inside.add(id(x))
    nested = [x for x in own if id(x) in inside]
    if best.name == "article" and main is not None and main.name == "main":
        keep = {id(x) for x in own if id(x) not in inside and _article_of(x.parent) is main and id(x) in prose and x.links <= LINKED * x.chars and not (id(x) in teasers and id(best) not in teasers)}
    if id(best) not in teasers:
        gone = {id(x) for x in nested if id(x) in teasers}
    around: dict[int, int] = {}  # how many nested articles a part holds
    over: dict[int, int] = {}  # the first heading of comments that stands in an article itself
    for x in reversed(page.nodes):
        if id(x) in inside:
            around[id(x)] = around.get(id(x), 0) + (x.name == "article" and x is not best and id(x) in holders)
            if x.parent is not None and id(x.parent) in inside:
                around[id(x.parent)] = around.get(id(x.parent), 0) + around[id(x)]
    for k, (at, value, _) in enumerate(page.texts):
        holder = _holder(at)
        if at.name in HEADING and id(holder) in inside and around.get(id(holder)) and COMMENTS.fullmatch(value):
            if holder is best or holder.name in ("article", "main"):
                silent.add(k)
                over.setdefault(id(holder), at.order)
            else:
                gone.add(id(holder))
    gone |= {id(x) for x in nested if over.get(id(x.parent), x.order) < x.order}
    return keep, gone, silent


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = parse(source)
    if not page.texts:
        return ""
    holders: dict[int, Node] = {}
    for at, _, _ in page.texts:
        node = _holder(at)
        while node is not None and id(node) not in holders:
            holders[id(node)] = node
            node = node.parent
    best = max(holders.values(), key=lambda x: (_discounted(x), -x.depth))
    # lists and tables are part of the container around them
    while best.parent is not None and best.name in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "blockquote", "figure"):
        best = best.parent
    top = best
    while top.parent is not None and top.name not in ("article", "main"):
        top = top.parent
    best = top if top.name in ("article", "main") else best
    keep, beside = {id(best)}, set()  # beside: parents whose own headings and prose are kept
    if best.parent is not None:
        keep |= _parts(best, page, holders, beside)
    more, gone, silent = _articles(best, page, holders) if best.name in ("article", "main") else (set(), set(), set())
    keep |= more
    for x in page.nodes:  # those inside come after
        x.kept = id(x) not in gone and (id(x) in keep or bool(x.parent and x.parent.kept))
    text = []
    for k, (at, value, linked) in enumerate(page.texts):
        if k in silent:
            continue
        heading = at.name in HEADING
        own = id(_holder(at)) in beside and (not linked if heading else _prose(value, linked))
        paragraph = best.parent is not None and at.parent is best.parent and at.name == "p" and not linked and _prose(value, linked)
        if at.kept or own or paragraph:
            text.append(value)
    return "\n".join(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in valid(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: The same result for pages whose main text is one article of headings and paragraphs; SQL can not score a tree.
TEMPLATE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>)', 1) AS a FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(a, '</?(?:h1|p)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS b FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g') AS c FROM b),
l AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM l
"""
