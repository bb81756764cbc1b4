"""HTML as browsers read it: one pass over the tokens of a page, with the end tags that authors leave out.

Beside the regular expressions of ``html.py``: slower, and right where markup is broken. Pages are cut into tokens by one
compiled pattern; a stack of open elements says what an end tag, or the lack of one, means.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks carry these functions with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without text, elements that end a line.
UNSEEN = frozenset("script style noscript svg iframe template".split())
LINES = frozenset("p div li h1 h2 h3 h4 h5 h6 tr section article".split())

# Fixed values of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
RAW_TEXT = frozenset("textarea title".split())
HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
#: Their start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li listing main menu nav ol p plaintext pre search section summary ul dd dt xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A paragraph outside of these stays open when one begins inside.
P_LIMITS = frozenset("applet button caption html marquee object table td template th svg".split())
#: What an end tag never reaches through.
TABLE_LIMITS = frozenset("table template html".split())
#: Start tag: what it ends, and where the search for that stops.
ENDED = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "caption", "colgroup"), "td": ("td", "th", "caption", "colgroup"), "th": ("td", "th", "caption", "colgroup"),
    "tbody": ("tbody", "thead", "tfoot", "caption", "colgroup"), "thead": ("tbody", "thead", "tfoot", "caption", "colgroup"), "tfoot": ("tbody", "thead", "tfoot", "caption", "colgroup"),
}
STOPS = {
    "li": frozenset("ol ul menu dir table td th section article body html template".split()),
    "dd": frozenset("dl table td th section article body html template".split()),
    "dt": frozenset("dl table td th section article body html template".split()),
    "option": frozenset("select datalist html".split()),
    "optgroup": frozenset("select html".split()),
}
SPECIAL = frozenset(
    "address applet article aside blockquote body button caption center col colgroup dd details dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe li listing main marquee menu nav noembed "
    "noframes noscript object ol p plaintext pre script search section select style summary table tbody td template textarea tfoot "
    "th thead title tr ul xmp".split()
)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comments, the last perhaps without an end
    r"|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=|[\"'])*+)(?P<close>>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")


def attribute(rest: str, name: str) -> str | None:
    """Value of the first attribute of this name: empty if it has none, None if there is no such attribute."""
    for key, double, single, bare in _ATTRIBUTE.findall(rest):
        if key.lower() == name:
            return html.unescape(double or single or bare)
    return None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page; kinds are text, start, end. Text is decoded."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", html.unescape(page[at:]), ""
            return
        if found.start() > at:
            yield "text", html.unescape(page[at : found.start()]), ""
        at = found.end()
        if found["name"] is None:
            continue
        if not found["close"]:
            return  # the page ends inside a tag, which then is none
        name = found["name"].lower()
        if found["end"]:
            yield "end", name, ""
            continue
        yield "start", name, found["rest"]
        if name in RAW or name in RAW_TEXT:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", html.unescape(page[at:stop]) if name in RAW_TEXT else page[at:stop], ""
            at = stop
            if end is None:
                yield "end", name, ""


class Page:
    """Visible text and links of one page, in one pass over its tokens."""

    def __init__(self, page: str):
        self.out: list[str] = []
        self.links: list[list] = []  # href, pieces of text
        self.stack: list[tuple[str, int]] = []  # open elements, with the number of their link or -1
        self.hidden = 0
        self.body = False
        self.lost = -1  # a link whose element ended without an end tag of its own: it goes on in what follows
        for kind, name, rest in tokens(page):
            getattr(self, kind)(name, rest)
        while self.stack:
            self._pop()

    def text(self, text: str, _: str) -> None:
        raw = self.stack[-1][0] if self.stack else ""
        if not self.body and raw not in HEAD and text.strip():
            self._begin()
        self._link_again()
        if self.body and not self.hidden:
            self.out.append(text)
        # A link's text counts wherever it stands, also inside an element without visible text.
        for _name, link in self.stack:
            if link >= 0:
                self.links[link][1].append(text)

    def start(self, name: str, rest: str) -> None:
        if name in ("html", "head"):
            return
        if name == "body" or name not in HEAD:
            self._begin()
        if name == "body":
            return
        if self._inside("svg"):
            if not rest.rstrip().endswith("/"):
                self._push(name)
            return
        if name in ENDS_P or name == "table":
            self._end("p", P_LIMITS)
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._pop()
        for ended in ENDED.get(name, ()):
            self._end(ended, STOPS.get(name, TABLE_LIMITS))
        if name == "a":
            self._end("a", TABLE_LIMITS | P_LIMITS)
            self.lost = -1
        if name not in ENDS_P and name not in ("table", "a", *ENDED):
            self._link_again()
        if name in VOID:
            if name == "br":
                self._line()
            return
        if name == "svg" and rest.rstrip().endswith("/"):
            return
        self._push(name, rest)

    def end(self, name: str, _: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name == "br" or name == "p" and not self._open("p", P_LIMITS):
            self._line()  # stands for a whole element
            return
        if name in HEADINGS:
            name = next((n for n, _ in reversed(self.stack) if n in HEADINGS), name)
        if name == "a":
            self.lost = -1
        limits = frozenset() if name in UNSEEN or name in TABLE_LIMITS else TABLE_LIMITS if name in ENDED else P_LIMITS - {name}
        if name not in SPECIAL and name != "a" and not self._inside("svg"):
            # An inline element's end does not close the block around it.
            limits = SPECIAL
        self._end(name, limits)

    # ---- the stack

    def _begin(self) -> None:
        self.body = True

    def _inside(self, name: str) -> bool:
        return any(n == name for n, _ in self.stack)

    def _open(self, name: str, limits: frozenset) -> bool:
        for own, _ in reversed(self.stack):
            if own == name:
                return True
            if own in limits:
                return False
        return False

    def _end(self, name: str, limits: frozenset) -> None:
        if self._open(name, limits):
            while self._pop(name) != name:
                pass

    def _push(self, name: str, rest: str = "") -> None:
        link = -1
        if name == "a" and (href := attribute(rest, "href")) is not None:
            link = len(self.links)
            self.links.append([href, []])
        self.stack.append((name, link))
        self.hidden += name in UNSEEN

    def _pop(self, wanted: str = "") -> str:
        name, link = self.stack.pop()
        self.hidden -= name in UNSEEN
        if name in LINES:
            self._line()
        if link >= 0 and wanted != "a" and wanted:
            self.lost = link
        return name

    def _line(self) -> None:
        if self.body and not self.hidden:
            self.out.append("\n")

    def _link_again(self) -> None:
        """A link that lost its element goes on as another one with the same address."""
        if self.lost >= 0:
            href, self.lost = self.links[self.lost][0], -1
            self.stack.append(("a", len(self.links)))
            self.links.append([href, []])


_SPACE = "[\\t\\n\\v\\f\\r \u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS, _BREAKS = re.compile("[ \\t\\f\\v\u00a0]+"), re.compile(f"{_SPACE}*\\n{_SPACE}*")
_ENDS = re.compile(f"^{_SPACE}+|{_SPACE}+$")


def page_parts(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Visible text, one line per block with white space collapsed, and (href, text) of the links in document order."""
    read = Page(page)
    text = _ENDS.sub("", _BREAKS.sub("\n", _BLANKS.sub(" ", "".join(read.out))))
    return text, [(_ENDS.sub("", href), _ENDS.sub("", "".join(own))) for href, own in read.links]


PARTS = "struct<text:string,links:array<struct<href:string,text:string>>>"
_LINKS = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))


#: Pages whose parts are Python objects at a time.
PAGES = 128


def _parts(pages: pa.Array) -> pa.Array:
    found = [None if p is None else page_parts(p) for p in pages.to_pylist()]
    texts = pa.array([None if f is None else f[0] for f in found], pa.string())
    links = pa.array([None if f is None else [{"href": h, "text": t} for h, t in f[1]] for f in found], _LINKS)
    return pa.StructArray.from_arrays([texts, links], ["text", "links"], mask=pa.array([f is None for f in found], pa.bool_()))


def parts_of(pages: pa.Array) -> pa.Array:
    """Text and links of the pages of a batch. It is read in pieces: a batch as Python objects takes many times its bytes."""
    return pa.concat_arrays([_parts(pages.slice(at, PAGES)) for at in range(0, max(len(pages), 1), PAGES)])


def parsed(page: Column) -> Column:
    """Text and links of a page, parsed once, batch by batch; NULL stays NULL."""

    @F.arrow_udf(PARTS)
    def parts(pages: pa.Array) -> pa.Array:
        return parts_of(pages)

    return parts(page)
