"""Leaf blocks of an HTML page: texts between block boundaries, with their ancestors.

A tolerant reader: tags are found by one pattern, text elements such as scripts run to their
own end tag, a paragraph ends where a block begins, list items, cells and options end where
the next one begins, and an end tag closes all that is open above its element; end tags
without an element are ignored.  Comments, declarations, scripts and styles give no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
_BARE = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: element kinds of the HTML standard
RAW = frozenset("script style template textarea title xmp iframe noembed noframes svg math canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html ins label legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: an element of the first kind ends open ones of the second, unless one of the third lies between
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_KEEPS_P = frozenset(("td", "th", "button", "caption", "table"))
_PLAIN = frozenset(("html", "body"))
SECTIONS = frozenset("article aside footer form header main nav".split())


@dataclass(frozen=True)
class Path:
    """What the open elements say together; one object for each set of features."""

    features: frozenset[str]
    parent: str  # the innermost block element
    named: str  # the names of the innermost element that has any


@dataclass
class Block:
    path: Path
    text: str
    linked: int  # characters within links, white space left out


class Paths:
    """Paths by what they are made of, so that pages share them."""

    def __init__(self, limit: int = 200_000) -> None:
        self._known: dict[tuple[Path, str, str], Path] = {}
        self._limit = limit
        self.root = Path(frozenset(), "", "")

    def under(self, path: Path, tag: str, attrs: str) -> Path:
        key = (path, tag, attrs)
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= self._limit:
                self._known.clear()
            own = set() if tag in _PLAIN else {f"t:{tag}"}
            words = names(attrs)
            own |= {f"c:{w}" for w in words}
            if _BARE.search(attrs):
                own.add("hidden")
            features = path.features if own <= path.features else path.features | own
            parent = tag if tag in BLOCK else path.parent
            named = " ".join(words) or (tag if tag in SECTIONS else path.named)
            same = features is path.features and parent == path.parent and named == path.named
            found = path if same else Path(features, parent, named)
            self._known[key] = found
        return found


def names(attrs: str) -> list[str]:
    """Words of class, id, role and itemprop values, in lower case, without digits."""
    if not attrs or "=" not in attrs:
        return []
    out = []
    for key, a, b, c in _ATTR.findall(attrs):
        if key.lower() in ("class", "id", "role", "itemprop"):
            out += [w.lower() for w in _WORD.findall(a or b or c)]
    return out


def squeezed(text: str) -> str:
    return " ".join(text.split())


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the text of a text element ends."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def leaf_blocks(page: str, paths: Paths) -> Iterator[Block]:
    """The blocks with any text, in page order."""
    stack: list[tuple[str, Path]] = [("", paths.root)]
    open_of: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = squeezed("".join(parts))
            if text:
                yield Block(stack[-1][1], text, linked)
            parts.clear()
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            open_of[stack.pop()[0]] -= 1

    def near(tags: tuple[str, ...], stops: tuple[str, ...] | frozenset[str]) -> int:
        """Place of the nearest open element of these, or 0."""
        if not any(open_of.get(t) for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                return 0
        return 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if open_of.get("a"):
                linked += len("".join(piece.split()))
        if not m:
            break
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"]:
            if tag == "br":
                parts.append(" ")
                continue
            place = near((tag,), ()) if open_of.get(tag) else 0
            if tag in BLOCK or any(t in BLOCK for t, _ in stack[place + 1 :] if place):
                yield from flush()
            if place:
                close(place)
            continue
        if tag in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                yield from flush()
            continue
        if tag in BLOCK:
            yield from flush()
            if tag in ENDS:
                while place := near(*ENDS[tag]):
                    close(place)
            elif tag not in ("label", "ins", "button") and (place := near(("p",), _KEEPS_P)):
                close(place)
        stack.append((tag, paths.under(stack[-1][1], tag, m["attrs"])))
        open_of[tag] = open_of.get(tag, 0) + 1
    yield from flush()
