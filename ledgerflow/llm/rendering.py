"""HTML extraction by layout-aware rendering.

A page is read into a tree with the tags that HTML implies (ends of paragraphs, list items,
cells; table bodies and rows), elements that are not shown are left out (by kind, by
attribute, or by what the page's own style sheets and inline styles say last for a screen), and the rest
is laid out as text: blocks on lines of their own with the blank lines their margins give,
list items with bullets or numbers, table cells in aligned columns. Runs of white space
collapse as in a browser, except in preformatted text.

Parsing one page is a small per-row helper; Spark deals the pages to tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks
from ledgerflow.llm.text import pieces

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_SHOWN = frozenset("head script style title template noscript datalist iframe object audio video canvas "
                      "noembed noframes area base link meta param source track input map rp "
                      "annotation annotation-xml".split())
#: Elements whose parts have no implied ends, what is read as a page inside them, and start tags that end them.
FOREIGN = frozenset("svg math".split())
PAGE_IN_FOREIGN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BORDERS = FOREIGN | PAGE_IN_FOREIGN
ENDS_FOREIGN = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu "
                         "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts of a drawing that are only shown where others refer to them.
DEFINITIONS = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
#: Blocks with a blank line before and after, and blocks that only start lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
LINED = frozenset("html body div section article header footer nav main aside address form li dt dd figcaption details "
                  "summary center dir menu hgroup search legend caption hr tr thead tbody tfoot option optgroup "
                  "dialog".split())
BLOCKS = SPACED | LINED
#: A start tag ends an open paragraph if it is one of these.
ENDS_P = BLOCKS - frozenset("html body tr thead tbody tfoot caption option optgroup legend summary table".split()) | {"table"}
#: A start tag ends the nearest open element of the first kinds, looked for up to one of the second kinds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}), "colgroup": ({"caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: End tags do not reach across these.
SCOPE = frozenset("table td th caption html template object".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption colgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link style script base template noscript".split())
#: Elements nested deeper than this are laid as siblings, as browsers do.
MAX_DEPTH = 200
BULLET, COLUMN_GAP = "- ", "  "
#: Lines of a cell longer than this do not widen their column, and no cell is moved further right than
#: ``PADDED``: later cells of such a line follow after a gap. So a line gets 400 blanks at most.
WIDEST, PADDED = 120, 400

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.DOTALL)
_DECLARATION = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?=[;}]|\Z)",
                          re.IGNORECASE)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)\Z")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]")
#: The screen that style sheets are read for, in pixels.
SCREEN_WIDTH, SCREEN_HEIGHT = 1280, 800
_MEDIA = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference",
          "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled"}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)


class Node:
    __slots__ = ("attributes", "children", "shown", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.shown = True


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value[:1] else value))
    return out


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attribute text): kinds are text, start and end."""
    at, n = 0, len(html)
    while at < n:
        to = html.find("<", at)
        if to < 0:
            yield "text", unescape(html[at:]), ""
            return
        if to > at:
            yield "text", unescape(html[at:to]), ""
        m = _TAG.match(html, to) or _LOOSE.match(html, to)
        if not m:
            yield "text", "<", ""
            at = to + 1
            continue
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            yield "end", name, ""
            continue
        yield "start", name, m.group(3)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            end = close.start() if close else n
            if end > at:
                yield "text", unescape(html[at:end]) if name in ("title", "textarea") else html[at:end], ""
            at = end


def build_tree(html: str) -> Node:
    """The element tree with implied tags."""
    root = Node("html", {})
    open_ = [root]
    body: Node | None = None
    drawn = False

    def close(kinds: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> bool:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in kinds:
                del open_[i:]
                return True
            if open_[i].tag in until:
                return False
        return False

    def border() -> int:
        """Place of the nearest open drawing or formula, or page inside one (0: none)."""
        return next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag in BORDERS), 0)

    def put(tag: str, attributes: dict[str, str]) -> Node:
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID and len(open_) < MAX_DEPTH:
            open_.append(node)
        return node

    for kind, name, rest in tokens(html):
        if kind == "text":
            top = open_[-1].tag
            if top in ("head", "html") and name.strip(" \t\n\r\f"):
                close({"head"}, set())  # text ends the head and begins the body
                if body is None:
                    body = put("body", {})
                elif open_[-1] is root:
                    open_.append(body)
            elif top in ("table", "thead", "tbody", "tfoot", "tr") and not name.strip(" \t\n\r\f"):
                continue
            open_[-1].children.append(name)
        elif kind == "start":
            if name in ("html", "body"):
                if name == "body" and body is None:
                    close({"head"}, set())
                    body = put("body", attributes_of(rest))
                elif name == "html" and not root.attributes:
                    root.attributes = attributes_of(rest)
                continue
            if open_[-1].tag == "head" and name not in IN_HEAD:
                open_.pop()
            if name == "head" and (body is not None or any(x.tag == "head" for x in open_)):
                continue
            if body is None and name not in IN_HEAD and name != "head" and open_[-1] is root:
                body = put("body", {})
            elif open_[-1] is root and body is not None:
                open_.append(body)
            inside = border() if drawn else 0
            foreign = open_[inside].tag in FOREIGN
            drawn = drawn or name in FOREIGN
            if foreign and name in ENDS_FOREIGN:
                while inside and open_[inside].tag not in PAGE_IN_FOREIGN:
                    del open_[inside:]
                    inside = border()
                foreign = False
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in HEADINGS and open_[-1].tag in HEADINGS:
                open_.pop()
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in ("a", "button"):
                close({name}, SCOPE | BLOCKS)
            # tags implied around rows and cells
            if name == "tr" and open_[-1].tag == "table":
                put("tbody", {})
            if name in ("td", "th"):
                if open_[-1].tag == "table":
                    put("tbody", {})
                if open_[-1].tag in ("thead", "tbody", "tfoot"):
                    put("tr", {})
            node = put(name, attributes_of(rest) if rest.strip(" /") else {})
            if (foreign or name in FOREIGN) and rest.endswith("/") and open_[-1] is node:
                open_.pop()
        elif name in ("html", "body"):
            continue
        elif name == "br":
            put("br", {})
        elif name == "p" and not any(x.tag == "p" for x in open_):
            put("p", {})
            open_.pop()
        elif name in HEADINGS:
            close(HEADINGS, SCOPE)
        else:
            close({name}, {"table"} - {name} if name in TABLE_PARTS else SCOPE - {name})
    return root


def _length(text: str) -> float | None:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?|\.\d+)\s*(px|em|rem|)\s*", text)
    return float(m.group(1)) * (16 if m.group(2) in ("em", "rem") else 1) if m else None


def _feature(text: str) -> bool:
    """A media feature in brackets, for the screen; unknown ones do not hold."""
    size = {"width": SCREEN_WIDTH, "height": SCREEN_HEIGHT, "device-width": SCREEN_WIDTH, "device-height": SCREEN_HEIGHT}
    m = re.fullmatch(r"\s*(min-|max-)?((?:device-)?(?:width|height))\s*:\s*(.*)", text)
    if m:
        n, have = _length(m.group(3)), size[m.group(2)]
        return n is not None and (have >= n if m.group(1) == "min-" else have <= n if m.group(1) else have == n)
    m = re.fullmatch(r"(?:([^<>=]+?)\s*(<=?)\s*)?\s*(width|height)\s*(?:(<=?|>=?|=)\s*([^<>=]+))?\s*", text)
    if m:
        have, ok = size[m.group(3)], True
        if m.group(1):
            n = _length(m.group(1))
            ok = n is not None and (n <= have if m.group(2) == "<=" else n < have)
        if m.group(4):
            n = _length(m.group(5))
            ok = ok and n is not None and {"<": have < n, "<=": have <= n, ">": have > n, ">=": have >= n, "=": have == n}[m.group(4)]
        return ok
    name, _, value = (x.strip() for x in text.partition(":"))
    return name == "color" and not value or name in _MEDIA and value in ("", _MEDIA[name])


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for the screen."""
    for query in media.lower().split(","):
        words = re.findall(r"\([^()]*\)|[^\s()]+", query)
        negated = words[:1] == ["not"] and len(words) > 1
        ok, either = True, False
        for w in words[1:] if negated else words:
            if w in ("and", "only"):
                continue
            if w == "or":
                either = True
                continue
            holds = _feature(w[1:-1]) if w[0] == "(" else w in ("all", "screen")
            ok, either = (ok or holds) if either else (ok and holds), False
        if ok != negated:
            return True
    return False


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """The last declaration of display and of visibility, and whether it is important."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARATION.findall(body):
        name = name.lower()
        if name not in out or bool(important) >= out[name][0]:
            out[name] = (bool(important), value.lower())
    return out


class Compound:
    """An element's name, classes, ids and attributes in a selector."""

    def __init__(self, tag: str, parts: list[tuple[str, str, str, str]]):
        self.tag = "" if tag == "*" else tag.lower()
        self.classes = frozenset(name for kind, name, _, _ in parts if kind == ".")
        self.ids = frozenset(name for kind, name, _, _ in parts if kind == "#")
        self.attributes = [(name.lower(), value.strip("\"'") if value else None) for _, _, name, value in parts if name]

    def matches(self, node: Node, classes: set[str]) -> bool:
        a = node.attributes
        return ((not self.tag or self.tag == node.tag) and self.classes <= classes
                and all(x == a.get("id") for x in self.ids)
                and all(n in a and (v is None or a[n] == v) for n, v in self.attributes))


class Rules:
    """What the page's style sheets say of display and visibility, for selectors of names, classes, ids and
    attributes, one inside another (others are passed over), and which elements that shows."""

    def __init__(self, root: Node):
        #: Rules by one thing that the element must have.
        self.rules: dict[str, list[tuple]] = {}
        self.n = 0
        sheets: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                sheets.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        for node in sheets:
            if on_screen(node.attributes.get("media", "") or "all"):
                self._read("".join(c for c in node.children if isinstance(c, str)))
        self._decide(root, [], False)

    def _read(self, css: str) -> None:
        css = _COMMENT.sub("", css).replace("<!--", "").replace("-->", "")
        holds, start, at = [True], 0, 0
        while m := _CSS.search(css, at):
            at = m.end()
            if m.group() == ";":
                start = at
            elif m.group() == "}":
                if len(holds) > 1:
                    holds.pop()
                start = at
            elif m.group() == "{":
                head = css[start:m.start()].strip()
                start = at
                if head.startswith("@"):
                    name, rest = re.match(r"@([\w-]*)(.*)", head, re.DOTALL).groups()
                    ok = (on_screen(rest) if name.lower() == "media" else name.lower() == "layer"
                          or name.lower() == "supports" and not rest.strip().lower().startswith("not"))
                    holds.append(holds[-1] and ok)
                    continue
                depth, body = 1, []  # declarations, without rules nested in them
                while depth and (m := _CSS.search(css, at)):
                    if m.group() == "{":
                        if depth == 1:
                            body.append(css[start:m.start()].rpartition(";")[0] + ";")
                        depth += 1
                    elif m.group() == "}":
                        depth -= 1
                        if not depth:
                            body.append(css[start:m.start()])
                        start = m.end()
                    at = m.end()
                if depth == 1:
                    body.append(css[start:])
                if depth:
                    at = len(css)
                if holds[-1]:
                    self._add(head, "".join(body))

    def _add(self, selectors: str, body: str) -> None:
        said = _declared(body)
        if not said:
            return
        for selector in selectors.split(","):
            words = re.sub(r"\s*>\s*", " > ", selector).split()
            chain: list[tuple[str, Compound]] = []
            how = ""
            for w in words:
                if w == ">":
                    how = ">"
                    continue
                m = _COMPOUND.match(w)
                if not m:
                    chain = []
                    break
                chain.append((how, Compound(m.group(1) or "", _PART.findall(m.group(2)))))
                how = ""
            if not chain or how:
                continue
            weight = (sum(len(c.ids) for _, c in chain), sum(len(c.classes) + len(c.attributes) for _, c in chain),
                      sum(bool(c.tag) for _, c in chain))
            last = chain[-1][1]
            key = f"#{min(last.ids)}" if last.ids else f".{min(last.classes)}" if last.classes else last.tag
            self.n += 1
            self.rules.setdefault(key, []).append((weight, self.n, chain, said))

    def _said(self, node: Node, above: list[Node]) -> dict[str, str]:
        """Value of display and of visibility by the declaration that decides."""
        best: dict[str, tuple] = {}
        a = node.attributes
        classes = set(a["class"].split()) if "class" in a else set()
        if self.rules:
            keys = ["", node.tag, *(f".{c}" for c in classes)] + ([f"#{a['id']}"] if "id" in a else [])
            for key in keys:
                for weight, n, chain, said in self.rules.get(key, ()):
                    if chain[-1][1].matches(node, classes) and (len(chain) == 1 or _inside(chain, len(chain) - 1, above, len(above))):
                        for name, (important, value) in said.items():
                            rank = (important, False, weight, n, value)
                            if name not in best or rank > best[name]:
                                best[name] = rank
        if a.get("style"):
            for name, (important, value) in _declared(a["style"]).items():
                rank = (important, True, (), 0, value)
                if name not in best or rank[:2] > best[name][:2]:
                    best[name] = rank
        return {name: rank[-1] for name, rank in best.items()}

    def _decide(self, node: Node, above: list[Node], unseen: bool) -> bool:
        """Mark the elements that are not shown, take away text that is not visible; whether any is left."""
        above.append(node)
        some = False
        for child in node.children:
            if not isinstance(child, Node):
                some = some or not unseen
                continue
            a = child.attributes
            said = self._said(child, above) if a or self.rules else {}
            display = said.get("display", "revert")
            if display in ("revert", "revert-layer"):
                there = not ("hidden" in a and a["hidden"].lower() != "until-found") and (child.tag != "dialog" or "open" in a)
            else:
                there = display != "none"
            if child.tag in NOT_SHOWN or not there:
                child.shown = False
                continue
            visibility = said.get("visibility", "inherit")
            here = unseen if visibility in ("inherit", "unset", "revert", "revert-layer") else \
                visibility in ("hidden", "collapse")
            left = self._decide(child, above, here)
            child.shown = left or not here
            some = some or child.shown
        above.pop()
        if unseen:
            node.children = [c for c in node.children if isinstance(c, Node) and c.tag != "br"]
        return some

    def shows(self, node: Node) -> bool:
        return node.shown


def _inside(chain: list[tuple[str, Compound]], i: int, above: list[Node], n: int) -> bool:
    """Whether the elements around (``above``, up to ``n``) match the selector's parts before part ``i``."""
    if not i:
        return True
    for k in range(n - 1, -1, -1):
        around = above[k]
        if chain[i - 1][1].matches(around, set(around.attributes.get("class", "").split())) and _inside(chain, i - 1, above, k):
            return True
        if chain[i][0] == ">":
            return False
    return False


class Lines:
    """Text being laid out: finished lines, the current line, and the space due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now = ""
        self.space = False
        self.blank = False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._begin()
            self.now += first
            for line in rest:
                self.line(True)
                self.now = line
            return
        s = _SPACE.sub(" ", s)
        if not s:
            return
        if s[0] == " ":
            self.space = True
            s = s[1:]
        if not s:
            return
        end = s[-1] == " "
        self._begin()
        if self.space and self.now and not self.now.endswith(" "):
            self.now += " "
        self.now += s[:-1] if end else s
        self.space = end

    def _begin(self) -> None:
        if self.blank and not self.now:
            if self.lines:
                self.lines.append("")
            self.blank = False

    def line(self, always: bool = False) -> None:
        """End the current line (``always``: also an empty one)."""
        if self.now or always:
            self.lines.append(self.now.rstrip(" ") if not always else self.now)
        self.now, self.space = "", False

    def gap(self) -> None:
        self.line()
        self.blank = True

    def add(self, lines: list[str], first: str, rest: str) -> None:
        """Finished lines of an inner layout, indented."""
        self.line()
        if not lines:
            return
        self._begin()
        self.blank = False
        self.lines += [(first if not i else rest) + x if x or not i else "" for i, x in enumerate(lines)]

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return self.lines


def _drawing(node: Node, out: Lines, rules: Rules, keep: bool) -> None:
    """The texts of a drawing, apart from each other and from what is around."""
    for child in node.children:
        if not isinstance(child, Node) or not rules.shows(child) or child.tag in DEFINITIONS:
            continue
        if child.tag in ("text", "foreignobject"):
            out.space = True
            _lay(child, out, rules, keep)
            out.space = True
        else:
            _drawing(child, out, rules, keep)


def _number(text: str, default: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return max(-most, min(most, int(m.group(1)))) if m else default


def _lay(node: Node, out: Lines, rules: Rules, keep: bool) -> None:
    if node.tag == "details" and "open" not in node.attributes:
        children: list[Node | str] = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    else:
        children = node.children
    number = _number(node.attributes.get("start", ""), 1, 10**9) if node.tag == "ol" else 0
    for child in children:
        if isinstance(child, str):
            out.text(child, keep)
            continue
        tag = child.tag
        if tag == "br":
            out.line(True)
            continue
        if not rules.shows(child):
            continue
        if tag == "hr":
            out.gap()
        elif tag == "wbr":
            continue
        elif tag == "table":
            out.gap()
            out.add(_table(child, rules, keep), "", "")
            out.gap()
        elif tag == "li":
            if node.tag == "ol":
                number = _number(child.attributes.get("value", ""), number, 10**9)
                mark, number = f"{number}. ", number + 1
            else:
                mark = BULLET
            inner = Lines()
            _lay(child, inner, rules, keep)
            out.add(inner.done(), mark, " " * len(mark))
        elif tag in ("blockquote", "dd"):
            if tag == "blockquote":
                out.gap()
            inner = Lines()
            _lay(child, inner, rules, keep)
            out.add(inner.done(), "  ", "  ")
            if tag == "blockquote":
                out.gap()
        elif tag in SPACED:
            nested = tag in ("ul", "ol") and node.tag == "li"  # lists in items have no margins
            if nested:
                out.line()
            else:
                out.gap()
            _lay(child, out, rules, keep or tag == "pre")
            if nested:
                out.line()
            else:
                out.gap()
        elif tag in LINED:
            out.line()
            _lay(child, out, rules, keep)
            out.line()
        elif tag in ("td", "th"):  # a cell outside a table
            _lay(child, out, rules, keep)
            out.space = True
        elif tag == "svg":
            _drawing(child, out, rules, keep)
        elif tag == "q":
            out.text("“", keep)
            _lay(child, out, rules, keep)
            out.text("”", keep)
        else:
            _lay(child, out, rules, keep or tag in ("textarea", "listing", "xmp"))


def _rows(table: Node, rules: Rules) -> tuple[list[Node], list[Node]]:
    """Captions, and rows in the order they are shown: heads, bodies, feet."""
    captions: list[Node] = []
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    for child in table.children:
        if not isinstance(child, Node) or not rules.shows(child):
            continue
        if child.tag == "caption":
            captions.append(child)
        elif child.tag in parts:
            parts[child.tag] += [r for r in child.children if isinstance(r, Node) and r.tag == "tr" and rules.shows(r)]
        elif child.tag == "tr":
            parts["tbody"].append(child)
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"]


def _table(table: Node, rules: Rules, keep: bool) -> list[str]:
    captions, rows = _rows(table, rules)
    outer = Lines()
    for caption in captions:
        _lay(caption, outer, rules, keep)
        outer.line()
    # content that is not in rows stands before the table
    for child in table.children:
        if isinstance(child, str):
            outer.text(child, False)
        elif child.tag not in ("caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr") and rules.shows(child):
            holder = Node("div", {})
            holder.children = [child]
            _lay(holder, outer, rules, keep)
    for part in table.children:
        if isinstance(part, Node) and part.tag in ("thead", "tbody", "tfoot") and rules.shows(part):
            for child in part.children:
                if isinstance(child, str):
                    outer.text(child, False)
                elif child.tag != "tr" and rules.shows(child):
                    holder = Node("div", {})
                    holder.children = [child]
                    _lay(holder, outer, rules, keep)
    grid: list[list[list[str]]] = []
    spans: list[tuple[int, int, int]] = []  # row, column, columns of wide cells
    below: dict[int, int] = {}  # columns taken by cells from rows above
    for r, row in enumerate(rows):
        line: list[list[str]] = []
        for cell in row.children:
            if isinstance(cell, str):
                outer.text(cell, False)
                continue
            if not rules.shows(cell):
                continue
            while below.get(len(line), 0):
                line.append([])
            inner = Lines()
            if cell.tag in ("td", "th"):
                _lay(cell, inner, rules, keep)
            else:
                holder = Node("div", {})
                holder.children = [cell]
                _lay(holder, inner, rules, keep)
            wide = max(1, _number(cell.attributes.get("colspan", ""), 1, 1000))
            tall = max(1, _number(cell.attributes.get("rowspan", ""), 1, 65534))
            at = len(line)
            if wide > 1:
                spans.append((r, at, wide))
            line.append(inner.done())
            line += [[] for _ in range(wide - 1)]
            for c in range(at, at + wide):
                if tall > 1:
                    below[c] = tall
        while below.get(len(line), 0):
            line.append([])
        below = {c: n - 1 for c, n in below.items() if n > 1}
        grid.append(line)
    width = [0] * max(map(len, grid), default=0)
    wide_cells = {(r, c): n for r, c, n in spans}
    for r, line in enumerate(grid):
        for c, cell in enumerate(line):
            if (r, c) not in wide_cells:
                width[c] = max([width[c], *(len(x) for x in cell if len(x) <= WIDEST)])
            width[c] = max(width[c], int(any(cell)))  # columns of long lines or wide cells only are used, too
    for (r, c), n in wide_cells.items():
        longest = max((len(x) for x in grid[r][c] if len(x) <= WIDEST), default=0)
        need = longest - sum(width[c:c + n]) - len(COLUMN_GAP) * (n - 1)
        if need > 0:
            width[c + n - 1] += need
    used = [c for c, w in enumerate(width) if w]
    lines = outer.done()
    for r, line in enumerate(grid):
        for i in range(max((len(cell) for cell in line), default=0)):
            text = ""
            at = 0
            for c in used:
                cell = line[c] if c < len(line) else []
                if i < len(cell) and cell[i]:
                    gap = COLUMN_GAP if text else ""
                    text = (text + gap).ljust(min(at, PADDED)) + cell[i]
                at += width[c] + len(COLUMN_GAP)
            lines.append(text.rstrip(" "))
    return lines


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root = build_tree(html)
    out = Lines()
    _lay(root, out, Rules(root), False)
    return "\n".join(out.done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines), one row per row of ``pages``.

    Null and empty pages give empty text (no lines). Pages of any length are read whole; markup that is cut
    off or broken is read as far as it goes. Rows that repeat are each rendered; null ids stay; an empty
    table gives no rows; other columns are not read."""
    python_tasks(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            texts = [render(h) for h in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64()),
                                   pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                                  names=["page_id", "text", "n_chars", "n_lines"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
