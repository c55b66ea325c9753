"""Parts of HTML pages by selector: tags, #ids, .classes and [attributes], parted by blanks, > and commas.

A tolerant reader keeps a stack of open elements and matches each one when it opens; the
part ends where the element does.  Void elements have no content, scripts and styles are
passed over whole, and an end tag closes what is open above its element; elements that are
never closed end with the page.  Parts are slices of the page as it is written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</\s*([A-Za-z][^\s>]*)[^>]*>|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_PAIR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_SIMPLE = re.compile(r"""([#.]?)([\w-]+|\*)|\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]""")
# Elements of the HTML standard without content, and those with text only.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())


@dataclass(frozen=True)
class Simple:
    """What one element has to be; ``direct`` if its parent has to be what stands before it."""

    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str | None], ...]
    direct: bool

    def fits(self, element: "Element") -> bool:
        if self.tag and element.tag != self.tag:
            return False
        own = element.attributes
        return all(own.get("id") == i for i in self.ids) and all(c in own.get("class", "").split() for c in self.classes) and all(k in own and v in (None, own[k]) for k, v in self.attributes)


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    start: int
    reached: tuple[int, ...]  # by selector: bits of the steps that this element, or one around it, ends
    here: tuple[int, ...]  # by selector: bits of the steps that this element ends


def parse(selector: str) -> list[list[Simple]]:
    """The alternatives of a selector, each a chain from the outermost element on."""
    out = []
    for part in selector.split(","):
        chain, direct = [], False
        for word in part.replace(">", " > ").split():
            if word == ">":
                if direct or not chain:
                    raise ValueError(f"cannot read selector {selector!r}")
                direct = True
                continue
            found = list(_SIMPLE.finditer(word))
            if "".join(m[0] for m in found) != word:
                raise ValueError(f"cannot read selector {selector!r}")
            tags = [m[2].lower() for m in found if m[2] and not m[1] and m[2] != "*"]
            if len(tags) > 1:
                raise ValueError(f"cannot read selector {selector!r}")
            pick = lambda sign: tuple(m[2] for m in found if m[1] == sign and m[2])  # noqa: B023, E731
            chain.append(Simple(tags[0] if tags else None, pick("#"), pick("."), tuple((m[3].lower(), m[4]) for m in found if m[3]), direct))
            direct = False
        if not chain or direct:
            raise ValueError(f"cannot read selector {selector!r}")
        out.append(chain)
    return out


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, a, b, c in _PAIR.findall(text):
        out.setdefault(key.lower(), a or b or c)
    return out


def _opened(tag: str, attributes: dict[str, str], start: int, parent: Element | None, chains: list[list[Simple]]) -> Element:
    element = Element(tag, attributes, start, (), ())
    reached, here = [], []
    for k, chain in enumerate(chains):
        above, beside = (parent.reached[k], parent.here[k]) if parent else (0, 0)
        bits = 0
        for step, simple in enumerate(chain):
            before = step == 0 or (beside if simple.direct else above) >> (step - 1) & 1
            if before and simple.fits(element):
                bits |= 1 << step
        here.append(bits)
        reached.append(above | bits)
    element.reached, element.here = tuple(reached), tuple(here)
    return element


def select(page: str, chains: list[list[Simple]]) -> list[str]:
    """The parts of a page, by where they begin."""
    stack: list[Element] = []
    open_of: dict[str, int] = {}
    found: list[tuple[int, int]] = []

    def close(element: Element, end: int) -> None:
        open_of[element.tag] -= 1
        if any(element.here[k] >> (len(c) - 1) & 1 for k, c in enumerate(chains)):
            found.append((element.start, end))

    at = 0
    while m := _MARKUP.search(page, at):
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if open_of.get(tag):
                while True:
                    top = stack.pop()
                    close(top, m.end() if top.tag == tag else m.start())
                    if top.tag == tag:
                        break
        elif m[2]:
            tag = m[2].lower()
            element = _opened(tag, _attributes(m[3]), m.start(), stack[-1] if stack else None, chains)
            open_of[tag] = open_of.get(tag, 0) + 1
            if tag in VOID or m[3].rstrip().endswith("/"):
                close(element, m.end())
            elif tag in RAW:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                close(element, at)
            else:
                stack.append(element)
    for element in reversed(stack):
        close(element, len(page))
    return [page[a:b] for a, b in sorted(found, key=lambda x: (x[0], -x[1]))]


def content_parts(html: Column, selector: str) -> Column:
    """The parts of a page that a selector chooses, in page order; null pages have none."""
    chains = parse(selector)

    @F.arrow_udf(ArrayType(StringType()))
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([select(x.as_py() or "", chains) for x in pages], pa.list_(pa.string()))

    return run(html)


def content_html(html: Column, selector: str) -> Column:
    """The chosen parts, a line each, or null where there are none."""
    parts = content_parts(html, selector)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
