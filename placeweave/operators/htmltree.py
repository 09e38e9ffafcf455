"""The element tree of one page, as a browser builds it.

A captured page is what a browser showed, and the extraction rules ask for
parents, ancestors and subtrees; so the tree follows the HTML rules that decide
those: implied ``html``, ``head`` and ``body``; implied ends; table rows and
cells with their missing parents; content that a table cannot hold moved before
it; misnested formatting (``<b><p></b>``) split as browsers split it; foreign
(``svg``) content with self-closing tags.

Elements are numbers into parallel lists; an element's children are numbers
and text nodes (lists of strings).  :meth:`Tree.rows` then reads the finished
tree in document order.  Every scan goes up the open elements only, of which
there are at most ``MAX_DEPTH`` (deeper elements become siblings, as in
browsers), so time is linear in the page.
"""

from __future__ import annotations

from html.parser import HTMLParser


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# The element classes of the HTML tree construction rules.
VOID = _set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
HEAD_ONLY = _set("base basefont bgsound link meta noframes script style template title noscript")
SPECIAL = _set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd "
    "details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object "
    "ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot "
    "th thead title tr track ul wbr xmp")
CLOSES_P = _set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp")
BLOCK_ENDS = _set(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header "
    "hgroup listing main menu nav ol pre search section summary ul")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
SCOPE = _set("applet caption html table td th marquee object template")
BUTTON_SCOPE, LIST_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}
MARKERS = _set("applet caption marquee object td template th")
TABLE_CONTEXT = _set("table tbody tfoot thead tr")
TABLE_PARTS = _set("caption col colgroup tbody td tfoot th thead tr")
ROW_GROUPS, CELLS = _set("tbody tfoot thead"), _set("td th")
TABLE_MODES = TABLE_PARTS | {"table", "template", "html"}
#: Elements that end foreign content, and those in it that hold HTML again.
BREAKOUT = _set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var")
FOREIGN, INTEGRATION = _set("svg math"), _set("foreignobject desc title annotation-xml mi mo mn ms mtext")
MAX_DEPTH = 512
_SPACE = " \t\n\f\r"


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.kids: list[list] = []
        self.stack: list[int] = []             # open elements
        self.is_open: set[int] = set()
        self.count: dict[str, int] = {}        # open elements per name
        self.formatting: list[int | None] = []  # active formatting elements; None is a marker
        self.head: int | None = None
        self.body: int | None = None
        self.form: int | None = None
        self.foster = False
        self.fresh = True                      # the next text begins a node of its own

    # -- the parser's own bookkeeping that is not needed here ---------------

    def updatepos(self, i: int, j: int) -> int:
        return j

    def parse_marked_section(self, i, report=1):
        # ``<![`` is a bogus comment in HTML; the base class refuses some forms
        return self.parse_bogus_comment(i)

    # -- elements ------------------------------------------------------------

    def _new(self, tag: str, attrs: dict[str, str]) -> int:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parent.append(-1)
        self.kids.append([])
        return len(self.tags) - 1

    def _place(self, target: int) -> tuple[int, int]:
        """Where a node meant for ``target`` goes: (parent, position); before
        the table if that is open and cannot hold it."""
        if self.foster and self.tags[target] in TABLE_CONTEXT:
            for i in reversed(self.stack):
                if self.tags[i] == "table":
                    up = self.parent[i]
                    if up < 0:
                        break
                    kids = self.kids[up]
                    at = len(kids) - 1
                    while kids[at] is not i:
                        at -= 1
                    return up, at
        return target, len(self.kids[target])

    def _attach(self, node: int, target: int) -> None:
        up, at = self._place(target)
        self.parent[node] = up
        self.kids[up].insert(at, node)

    def _push(self, node: int) -> None:
        tag = self.tags[node]
        self.stack.append(node)
        self.is_open.add(node)
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in MARKERS:
            self.formatting.append(None)

    def _insert(self, tag: str, attrs: dict[str, str], leaf: bool = False) -> int:
        if len(self.stack) >= MAX_DEPTH:
            self._pop()
        node = self._new(tag, attrs)
        self._attach(node, self.stack[-1])
        if not leaf:
            self._push(node)
        return node

    def _pop(self) -> int:
        node = self.stack.pop()
        tag = self.tags[node]
        self.is_open.discard(node)
        self.count[tag] -= 1
        if tag in MARKERS:
            while self.formatting and self.formatting.pop() is not None:
                pass
        return node

    def _pop_to(self, tags) -> None:
        """Close the nearest open element of one of ``tags`` and all above."""
        while self.tags[self._pop()] not in tags:
            pass

    def _back_to(self, tags) -> None:
        """Close what is above the nearest open element of ``tags``."""
        while self.tags[self.stack[-1]] not in tags:
            self._pop()

    def _in_scope(self, tags, boundary=SCOPE) -> bool:
        if not any(self.count.get(t, 0) for t in tags):
            return False
        for i in reversed(self.stack):
            tag = self.tags[i]
            if tag in tags:
                return True
            if tag in boundary:
                return False
        return False

    def _close_p(self) -> None:
        if self.count.get("p", 0) and self._in_scope(("p",), BUTTON_SCOPE):
            self._pop_to(("p",))

    # -- text ----------------------------------------------------------------

    def _text(self, data: str) -> None:
        up, at = self._place(self.stack[-1])
        kids = self.kids[up]
        if at and not self.fresh and isinstance(kids[at - 1], list):
            kids[at - 1].append(data)
        else:
            kids.insert(at, [data])
        self.fresh = False

    def handle_data(self, data: str) -> None:
        if not data:
            return
        if self.body is None:
            top = self.tags[self.stack[-1]] if self.stack else None
            if top not in (None, "html", "head"):            # title, script, style …
                self._text(data)
                return
            rest = data.lstrip(_SPACE)
            space = data[:len(data) - len(rest)]
            if space and self.head is not None:              # before the head it is dropped
                self._text(space)
            if not rest:
                return
            self._start_body({})
            data = rest
        tag = self.tags[self.stack[-1]]
        if tag in TABLE_CONTEXT and data.strip(_SPACE):
            self.foster = True
            self._reconstruct()
            self._text(data)
            self.foster = False
            return
        if tag == "colgroup" and data.strip(_SPACE):
            self._pop()
            self.handle_data(data)
            return
        if tag not in TABLE_CONTEXT:
            self._reconstruct()
        self._text(data)

    def handle_comment(self, data: str) -> None:
        self.fresh = True

    def unknown_decl(self, data: str) -> None:
        self.fresh = True

    # -- before the body -----------------------------------------------------

    def _start_html(self, attrs: dict[str, str]) -> None:
        if not self.tags:
            self._push(self._new("html", attrs))
        else:
            for k, v in attrs.items():
                self.attrs[0].setdefault(k, v)

    def _start_head(self, attrs: dict[str, str]) -> None:
        self._start_html({})
        if self.head is None:
            self.head = self._insert("head", attrs)

    def _start_body(self, attrs: dict[str, str]) -> None:
        self._start_head({})
        while len(self.stack) > 1:
            self._pop()
        self.formatting.clear()
        self.body = self._insert("body", attrs)

    def _before_body(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether the start tag was settled before a body was there."""
        if self.stack and self.tags[self.stack[-1]] not in ("html", "head"):
            if tag == "head" or tag == "body" and self.count.get("template", 0):
                return True
            inside = self.tags[self.stack[-1]]
            if tag != "body":
                if inside in ("noscript", "template") or inside not in HEAD_ONLY:
                    self._insert(tag, attrs, leaf=tag in VOID)
                    return True
                self._pop()
        if tag in HEAD_ONLY:
            self._start_head({})
            closed = self.head not in self.is_open           # after </head>: still the head's
            if closed:
                self._push(self.head)
            node = self._insert(tag, attrs, leaf=tag in VOID)
            if closed:                                       # only what was put in stays open
                self.stack.remove(self.head)
                self.is_open.discard(self.head)
                self.count["head"] -= 1
            return node >= 0
        if tag == "head":
            self._start_head(attrs)
            return True
        self._start_body(attrs if tag == "body" else {})
        return tag == "body"

    # -- start tags ----------------------------------------------------------

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_starttag(self, tag, attrs, closed: bool = False) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            if k not in own:                 # the first of a repeated attribute wins
                own[k] = "" if v is None else v
        self.fresh = True
        if tag == "html":
            self._start_html(own)
            return
        if self.body is None and self._before_body(tag, own):
            return
        if tag in ("body", "head"):
            if tag == "body":
                for k, v in own.items():
                    self.attrs[self.body].setdefault(k, v)
            return
        if (self.count.get("svg", 0) or self.count.get("math", 0)) and self._in_foreign():
            if tag not in BREAKOUT:
                self._insert(tag, own, leaf=closed)
                return
            while self._in_foreign():
                self._pop()
        self._start(tag, own, closed)

    def _in_foreign(self) -> bool:
        for i in reversed(self.stack):
            if self.tags[i] in FOREIGN:
                return True
            if self.tags[i] in INTEGRATION:
                return False
        return False

    def _start(self, tag: str, own: dict[str, str], closed: bool = False) -> None:
        if tag in TABLE_PARTS:
            self._start_table_part(tag, own)
        elif self.tags[self.stack[-1]] in TABLE_CONTEXT:
            if tag == "table" and self._in_scope(("table",), ("template", "html")):
                self._pop_to(("table",))
                self._start(tag, own)
            elif tag in ("script", "style", "template"):
                self._insert(tag, own)
            elif tag == "form" and self.form is None:
                self.form = self._insert(tag, own, leaf=True)
            elif tag == "input" and own.get("type", "").lower() == "hidden":
                self._insert(tag, own, leaf=True)
            else:
                self.foster = True
                self._start_in_body(tag, own, closed)
                self.foster = False
        else:
            if self.tags[self.stack[-1]] == "colgroup" and tag != "template":
                self._pop()
                self._start(tag, own, closed)
                return
            self._start_in_body(tag, own, closed)

    def _start_in_body(self, tag: str, own: dict[str, str], closed: bool) -> None:
        if tag in CLOSES_P:
            if tag == "form":
                if self.form is not None and self.form in self.is_open:
                    return                                   # forms do not nest
            elif tag == "li":
                self._close_item(("li",))
            elif tag in ("dd", "dt"):
                self._close_item(("dd", "dt"))
            self._close_p()
            if tag in HEADINGS and self.tags[self.stack[-1]] in HEADINGS:
                self._pop()
            node = self._insert(tag, own, leaf=tag in VOID)
            if tag == "form":
                self.form = node
            return
        if tag in ("option", "optgroup"):
            if self.tags[self.stack[-1]] == "option":
                self._pop()
            if tag == "optgroup" and self.tags[self.stack[-1]] == "optgroup":
                self._pop()
        elif tag == "button" and self._in_scope(("button",)):
            self._pop_to(("button",))
        elif tag in ("a", "nobr"):
            if any(i is not None and self.tags[i] == tag for i in self._active()):
                self._end_formatting(tag)
        self._reconstruct()
        if tag in FORMATTING:
            self._note(self._insert(tag, own))
        else:
            self._insert("img" if tag == "image" else tag, own, leaf=tag in VOID or closed and tag in FOREIGN)

    def _close_item(self, tags) -> None:
        if not any(self.count.get(t, 0) for t in tags):
            return
        for i in reversed(self.stack):
            tag = self.tags[i]
            if tag in tags:
                self._pop_to(tags)
                return
            if tag in SPECIAL and tag not in ("address", "div", "p"):
                return

    def _start_table_part(self, tag: str, own: dict[str, str]) -> None:
        while True:
            mode = next((self.tags[i] for i in reversed(self.stack) if self.tags[i] in TABLE_MODES), "html")
            if mode == "html":
                return                                       # no table: the tag means nothing
            if mode == "template":
                self._insert(tag, own, leaf=tag in VOID)
                return
            if mode in CELLS or mode == "caption":
                self._pop_to((mode,))
            elif mode in ("colgroup", "col"):
                if tag == "col":
                    self._insert(tag, own, leaf=True)
                    return
                self._pop_to((mode,))
            elif mode == "tr":
                self._back_to(("tr",))
                if tag in CELLS:
                    self._insert(tag, own)
                    return
                self._pop()
            elif mode in ROW_GROUPS:
                self._back_to(ROW_GROUPS)
                if tag == "tr":
                    self._insert(tag, own)
                    return
                if tag in CELLS:
                    self._insert("tr", {})
                else:
                    self._pop()
            else:
                self._back_to(("table",))
                if tag in ROW_GROUPS or tag in ("caption", "colgroup"):
                    self._insert(tag, own)
                    return
                self._insert("colgroup" if tag == "col" else "tbody", {})

    # -- end tags ------------------------------------------------------------

    def handle_endtag(self, tag) -> None:
        self.fresh = True
        if self.body is None:
            if tag in ("br", "p"):
                self._start_body({})
            elif tag == "head":
                self._start_head({})
                while len(self.stack) > 1:
                    self._pop()
                return
            else:
                if self.count.get(tag, 0) and tag not in ("html", "body"):
                    self._pop_to((tag,))
                return
        if tag in ("html", "body", "head"):
            return                                           # what follows is still the body's
        top = self.stack[-1]
        if self.tags[top] == tag and (tag not in FORMATTING or self.formatting and self.formatting[-1] == top):
            self._pop()                                      # as a rule, the current element
            if tag in FORMATTING:
                self.formatting.pop()
            elif tag == "form":
                self.form = None
            return
        if tag == "br":
            self._start("br", {})
        elif tag == "p":
            if not self._in_scope(("p",), BUTTON_SCOPE):
                self._start("p", {})
            self._close_p()
        elif not self.count.get(tag, 0) and tag not in HEADINGS:
            return                                           # an end tag with no open element is ignored
        elif (self.count.get("svg", 0) or self.count.get("math", 0)) and self._in_foreign():
            self._end_foreign(tag)
        elif tag in TABLE_PARTS or tag == "table":
            if self._in_scope((tag,), ("table", "template", "html") if tag != "table" else ("template", "html")):
                self._pop_to((tag,))
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._pop_to(HEADINGS)
        elif tag in BLOCK_ENDS or tag in ("dd", "dt", "applet", "marquee", "object"):
            if self._in_scope((tag,)):
                self._pop_to((tag,))
        elif tag == "li":
            if self._in_scope(("li",), LIST_SCOPE):
                self._pop_to(("li",))
        elif tag == "form":
            self.form = None
            if self._in_scope(("form",)):
                self._pop_to(("form",))
        elif tag == "template":
            self._pop_to(("template",))
        else:
            self._end_other(tag)

    def _end_foreign(self, tag: str) -> None:
        for i in reversed(self.stack):
            if self.tags[i] == tag:
                self._pop_to((tag,))
                return
            if self.tags[i] in FOREIGN:
                break
        if tag in SPECIAL or tag in FORMATTING:
            while self._in_foreign():
                self._pop()
            self.handle_endtag(tag)

    def _end_other(self, tag: str) -> None:
        for i in reversed(self.stack):
            if self.tags[i] == tag:
                self._pop_to((tag,))
                return
            if self.tags[i] in SPECIAL:
                return

    # -- formatting elements -------------------------------------------------

    def _active(self) -> list[int]:
        """Active formatting elements after the last marker, newest first."""
        out = []
        for i in reversed(self.formatting):
            if i is None:
                break
            out.append(i)
        return out

    def _note(self, node: int) -> None:
        """Three alike are remembered at most, as in browsers."""
        same = [i for i in self._active() if self.tags[i] == self.tags[node] and self.attrs[i] == self.attrs[node]]
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def _reconstruct(self) -> None:
        """Open again the formatting elements that a block's end has closed."""
        if not self.formatting or self.formatting[-1] is None or self.formatting[-1] in self.is_open:
            return
        at = len(self.formatting) - 1
        while at and self.formatting[at - 1] is not None and self.formatting[at - 1] not in self.is_open:
            at -= 1
        for k in range(at, len(self.formatting)):
            old = self.formatting[k]
            self.formatting[k] = self._insert(self.tags[old], self.attrs[old])

    def _move(self, node: int, target: int) -> None:
        up = self.parent[node]
        if up >= 0:
            self.kids[up].remove(node)
        self._attach(node, target)

    def _unstack(self, node: int) -> None:
        self.stack.remove(node)
        self.is_open.discard(node)
        self.count[self.tags[node]] -= 1

    def _end_formatting(self, tag: str) -> None:
        """The end of a formatting element: if blocks were opened in it, the
        element is closed before the outermost of them and goes on inside."""
        for _ in range(8):
            node = next((i for i in self._active() if self.tags[i] == tag), None)
            if node is None:
                self._end_other(tag)
                return
            if node not in self.is_open:
                self.formatting.remove(node)
                return
            if not self._in_scope((tag,)):
                return
            at = self.stack.index(node)
            block = next((i for i in self.stack[at + 1:] if self.tags[i] in SPECIAL), None)
            if block is None:
                while self._pop() != node:
                    pass
                self.formatting.remove(node)
                return
            above, spot = self.stack[at - 1], self.formatting.index(node)
            last = block
            between = self.stack[at + 1:self.stack.index(block)]
            for n, inner in enumerate(reversed(between), 1):
                if inner in self.formatting and n > 3:
                    k = self.formatting.index(inner)
                    self.formatting.pop(k)
                    spot -= k < spot
                if inner not in self.formatting:
                    self._unstack(inner)
                    continue
                copy = self._new(self.tags[inner], self.attrs[inner])
                k = self.formatting.index(inner)
                self.formatting[k] = copy
                self.stack[self.stack.index(inner)] = copy
                self.is_open.discard(inner)
                self.is_open.add(copy)
                if last == block:
                    spot = k + 1
                self._move(last, copy)
                last = copy
            foster, self.foster = self.foster, True
            self._move(last, above)
            self.foster = foster
            copy = self._new(tag, self.attrs[node])
            self.kids[copy], self.kids[block] = self.kids[block], []
            for kid in self.kids[copy]:
                if not isinstance(kid, list):
                    self.parent[kid] = copy
            self.parent[copy] = block
            self.kids[block].append(copy)
            k = self.formatting.index(node)
            self.formatting.pop(k)
            self.formatting.insert(spot - (k < spot), copy)
            self._unstack(node)
            self.stack.insert(self.stack.index(block) + 1, copy)
            self.is_open.add(copy)
            self.count[tag] = self.count.get(tag, 0) + 1

    # -- the finished tree ---------------------------------------------------

    def finish(self) -> None:
        self.close()
        if self.body is None:
            self._start_body({})

    def rows(self) -> tuple[bytes, list[list], list[list[int]]]:
        """(text, elements, text nodes) in document order: an element is
        ``[idx, parent, depth, last, tag, attrs, t0, t1]``."""
        out: list[list] = []
        nodes: list[list[int]] = []
        text: list[bytes] = []
        pos = 0
        path: list[tuple[list, object]] = []
        if self.tags:
            out.append([0, -1, 0, 0, self.tags[0], self.attrs[0], 0, 0])
            path.append((out[0], iter(self.kids[0])))
        while path:
            row, kids = path[-1]
            for kid in kids:
                if isinstance(kid, list):
                    chunk = "".join(kid).encode("utf-8", "replace")
                    nodes.append([pos, pos + len(chunk)])
                    text.append(chunk)
                    pos += len(chunk)
                else:
                    below = [len(out), row[0], len(path), 0, self.tags[kid], self.attrs[kid], pos, pos]
                    out.append(below)
                    path.append((below, iter(self.kids[kid])))
                    break
            else:
                path.pop()
                row[3], row[7] = len(out) - 1, pos
        return b"".join(text), out, nodes
