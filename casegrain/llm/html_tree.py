"""HTML texts as trees of blocks: a tolerant builder on the standard tokenizer.

The tree holds block elements and, as leaves, the text runs between their borders. Inline
elements join the run around them, ``<br>`` is white space, and what never shows as text (scripts, styles, comments,
controls, embedded objects, the head) is left out. Missing and crossed end tags are mended: a new block ends an open
paragraph, a new item or cell ends the one before, an end tag without a start is ignored, and the end of the text ends everything.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# ---- fixed values: element names of the HTML standard by role ------------------
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video map select button textarea "
                   "datalist dialog applet noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title script style noscript template base link meta".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 header hgroup legend li listing main menu nav ol p pre search section summary "
                  "table caption colgroup tbody td tfoot th thead tr ul xmp".split())
# A start tag of the left ends the open elements of the right, up to one of the borders.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
        "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)),
        "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KEEPS_P = frozenset("html body td th caption".split())
# --------------------------------------------------------------------------------
_NAME_PART = re.compile(r"[a-z]+")
_OPEN_END = re.compile(r"</?[a-zA-Z]|<!|<\?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Tree:
    """Nodes in page order, parents before children: tag ('' for a text run), parent, hint words, text, link characters."""

    def __init__(self):
        self.tag, self.parent, self.words, self.text, self.linked, self.label = ["html"], [-1], [frozenset()], [""], [0], [0]

    def add(self, tag: str, parent: int, words: frozenset, text: str, linked: int, label: int) -> int:
        for column, value in zip((self.tag, self.parent, self.words, self.text, self.linked, self.label),
                                 (tag, parent, words, text, linked, label)):
            column.append(value)
        return len(self.tag) - 1


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.stack = [("html", 0)]          # open blocks and hidden elements; hidden ones have no node (-1)
        self.hidden = 0
        self.open = Counter()               # open elements by name
        self.run, self.link = [], 0
        self.in_link = -1                   # stack height at which a link was opened

    # -- runs ------------------------------------------------------------------
    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                node = self.stack[-1][1]
                self.tree.add("", node, frozenset(), text, min(self.link, len(text)), self.tree.label[node])
            self.run, self.link = [], 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.run.append(data)
            if self.in_link >= 0:
                self.link += len(data)

    # -- elements --------------------------------------------------------------
    def _pop(self, upto: int) -> None:
        """End the open elements from place ``upto`` on."""
        if not self.hidden:
            self._flush()
        while len(self.stack) > upto:
            tag, node = self.stack.pop()
            self.open[tag] -= 1
            self.hidden -= node < 0
        if self.in_link > len(self.stack):
            self.in_link = -1

    def _push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.hidden += node < 0

    def _open(self, names, borders) -> int:
        """Place of the innermost open element of ``names`` within the borders, or 0."""
        if not any(self.open[n] for n in names):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                return i
            if self.stack[i][0] in borders:
                break
        return 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden and self.stack[-1][0] == "head" and tag not in HEAD_ONLY and tag != "head":
            self._pop(len(self.stack) - 1)      # what no head can hold ends it
        if tag in VOID:
            if tag == "hr" and not self.hidden:
                self._flush()
            elif tag == "br" and not self.hidden:
                self.run.append(" ")
            return
        if tag in HIDDEN:
            if not self.hidden:
                self.run.append(" ")
            self._push(tag, -1)
            return
        if self.hidden:
            if tag in BLOCK:
                self._push(tag, -1)
            return
        if tag == "a":
            self.in_link = len(self.stack)
        if tag not in BLOCK or tag == "html":
            return
        if tag == "body" and self._open(("body",), ()):
            return
        self._flush()
        if tag in ENDS:
            at = self._open(*ENDS[tag])
            if at:
                self._pop(at)
        elif tag not in KEEPS_P:
            at = self._open(("p",), ("td", "th", "caption"))
            if at:
                self._pop(at)
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self._pop(len(self.stack) - 1)
        node = self.stack[-1][1]
        label, words = self.tree.label[node], set()
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                words.update(_NAME_PART.findall(_CAMEL.sub("-", value).lower()))
            elif name == "data-label":
                label = int(value == "1")
        self._push(tag, self.tree.add(tag, node, frozenset(words), "", 0, label))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)        # a slash ends void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = -1
        if tag in VOID or tag in ("html", "body") or tag not in BLOCK and tag not in HIDDEN:
            return
        # A cell's end tags don't reach out of their table.
        at = self._open(HEADINGS if tag in HEADINGS else (tag,), () if tag in ("table", "form") else ("table",) if tag not in HIDDEN else ())
        if at:
            self._pop(at)
            if tag in HIDDEN and not self.hidden:
                self.run.append(" ")


def parse(html: str) -> Tree:
    """The tree of a page; ``data-label`` attributes of labelled pages become the labels of the nodes below them."""
    b = _Builder()
    cut = html.rfind("<")
    if cut > html.rfind(">") and _OPEN_END.match(html, cut):
        html = html[:cut]           # a tag or comment that the end of the text cuts off shows nothing
    b.feed(html)
    b.close()
    b._pop(1)
    b._flush()
    return b.tree
