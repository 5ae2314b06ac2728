"""A small HTML parser: the elements of a page as arrays, with the texts between their tags."""

from __future__ import annotations

import html
import re

#: Fixed values of the HTML standard: elements by how they end and how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
#: Of these, the ones that go on to the end of the page if nothing ends them.
TO_END = frozenset("script style textarea title".split())
FOREIGN = ("svg", "math")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var wbr"
    " mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder semantics".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# an attribute; quotes delimit only a value, and only if they are closed
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))"
_PLAIN_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:" + _VALUE.replace("([", "(?:[") + ")?+"
_MARKUP = re.compile(rf"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PLAIN_ATTRIBUTE})*+)(>|$)|<[!?/][^>]*+(?:>|$)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TOLD = frozenset("class id role hidden style".split())


def told(attributes: str) -> str:
    """Values of the attributes that tell what an element is for, names of those without a value, in small letters."""
    found = ((m[1].lower(), m[2] or m[3] or m[4] or m[1]) for m in _ATTRIBUTE.finditer(attributes))
    return " ".join(value for name, value in found if name in _TOLD).lower()


class Page:
    """``tags``, ``parents`` (-1 for the root), ``marks`` (class, id and role words) of each element in page
    order, and ``texts``: (element, text, whether a block ends before it)."""

    def __init__(self, source: str | None):
        self.tags, self.parents, self.marks = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str, bool]] = []
        self._parse(source or "")

    def _text(self, at: int, raw: str, broken: bool) -> bool:
        if raw:
            self.texts.append((at, html.unescape(raw) if "&" in raw else raw, broken))
            return False
        return broken

    def _parse(self, source: str) -> None:
        stack, begin, broken, end = [0], 0, True, len(source)
        self._open: dict[str, int] = {}
        while begin < end:
            m = _MARKUP.search(source, begin)
            if m is None:
                self._text(stack[-1], source[begin:], broken)
                break
            broken = self._text(stack[-1], source[begin : m.start()], broken)
            begin, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                broken |= name not in INLINE and not any(self._open.get(f) for f in FOREIGN)
                if self._open.get(name):
                    k = len(stack) - 1
                    while self.tags[stack[k]] != name:
                        k -= 1
                    self._end(stack, k)
                continue
            foreign = any(self._open.get(f) for f in FOREIGN)
            broken |= name not in INLINE and not foreign
            if name in RAW:  # what it holds isn't text of the page
                close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(source, begin)
                if close or name in TO_END:
                    begin = close.end() if close else end
                continue
            if name in VOID:
                continue
            self._close_for(name, stack)
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.marks.append(told(m[3]) if m[3] else "")
            if (foreign or name in FOREIGN) and m[3].endswith("/"):
                continue
            stack.append(len(self.tags) - 1)
            self._open[name] = self._open.get(name, 0) + 1

    def _end(self, stack: list[int], k: int) -> None:
        for i in stack[k:]:
            self._open[self.tags[i]] -= 1
        del stack[k:]

    def _close_for(self, name: str, stack: list[int]) -> None:
        """End elements that the start of ``name`` ends: an open paragraph, the last item of the same list or row."""
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[k]]
                if tag == "p":
                    self._end(stack, k)
                    break
                if tag not in INLINE:
                    break
        elif name in _SAME:
            same, stop = _SAME[name]
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[k]]
                if tag in stop:
                    break
                if tag in same:
                    self._end(stack, k)
                    if name != "tr" or tag == "tr":
                        break
