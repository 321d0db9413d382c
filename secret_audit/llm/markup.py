"""Text, title, language and links of a web page in one forward pass.

The pass finds the next ``<``, reads the tag there once, quotes included, and goes on behind it, so its time grows with the
length of the page alone, whatever the page holds. A tag that no ``>`` outside quotes ends shows that a quote is missing: from
there on quotes count for nothing and tags end at the next ``>``. Where no ``>`` follows at all, the rest is text.

Comments, scripts, styles, templates, frames and drawings give no text, also when they are not closed. A drawing (svg) that
closes itself holds nothing, and one that is not closed ends where a block of the page begins. What a page shows without
scripts (noscript) is text.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

#: Elements whose content is no markup, and elements whose content is neither text nor links.
RAW = ("script", "style", "iframe")
HIDDEN = ("svg", "template")
#: Elements that begin a new line.
BLOCKS = frozenset(
    (
        "address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
        "th thead title tr ul"
    ).split()
)
LINKS = frozenset(("a", "area", "link", "img", "base"))
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in (*RAW, "title")}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_LANGUAGE = re.compile(r"[\w-]+")
# Runs of white space that aren't a single blank already.
_SPACES, _LINES = re.compile(r"[^\S\n ][^\S\n]*+| [^\S\n]++"), re.compile(r" ?\n[ \n]*+")
_LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,}+);?")


def unescaped(text: str) -> str:
    """Character references resolved; numbers beyond all characters become the replacement character, however long."""
    return html.unescape(_LONG_NUMBER.sub("�", text)) if "&" in text else text


def attribute(tag: str, names: tuple[str, ...]) -> str | None:
    """Value of the first attribute of a tag that has one of the names."""
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() in names and m[2] is not None:
            return m[2].strip("\"'") if m[2][0] in "\"'" else m[2]
    return None


class Page:
    """What one pass over a page finds: text, title, language and links as (element, target as written)."""

    def __init__(self, page: str):
        self.page, self.parts, self.links = page, [], []
        self.title: str | None = None
        self.language: str | None = None
        self._read()
        text = _LINES.sub("\n", _SPACES.sub(" ", unescaped("".join(self.parts))))
        self.text = text.strip(" \n")
        if self.title is not None:
            self.title = _SPACES.sub(" ", unescaped(self.title)).strip()

    def _say(self, text: str, hidden: bool) -> None:
        if text and not hidden:
            text = text.replace("\n", " ")
            self.parts.append(text)
            if self._titled:
                self.title += text

    def _read(self) -> None:
        page, at, tag, unclosed = self.page, 0, _TAG, set()
        last, hidden, depth = page.rfind(">"), "", 0
        self._titled = False
        while True:
            i = page.find("<", at)
            if i < 0 or i > last:
                break
            m = tag.match(page, i)
            if m is None:
                if page.startswith("<!--", i):
                    self._say(page[at:i], bool(hidden))
                    end = page.find("-->", i + 2)  # <!--> is a comment, too
                    if end < 0:
                        return
                    self._say(" ", bool(hidden))
                    at = end + 3
                elif page.startswith(("<!", "<?"), i):
                    self._say(page[at:i], bool(hidden))
                    at = page.find(">", i) + 1
                elif tag is _TAG and _BARE_TAG.match(page, i):
                    tag = _BARE_TAG
                else:
                    self._say(page[at : i + 1], bool(hidden))
                    at = i + 1
                continue
            self._say(page[at:i], bool(hidden))
            close, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
            if hidden:
                if name == hidden:
                    depth += -1 if close else not rest.endswith("/")
                elif hidden == "svg" and name in BLOCKS and name != "title":
                    depth = 0
                if name == hidden or not depth:
                    hidden = hidden if depth else ""
                    if not depth and name in BLOCKS:
                        self.parts.append("\n")
                elif name in RAW and not close and not rest.endswith("/"):
                    at = self._skip(name, at, last, unclosed)
                continue
            if name in BLOCKS:
                if name == "title":
                    self._title(close, at, last, unclosed)
                self.parts.append("\n")
                if name == "html" and not close and self.language is None and rest:
                    found = _LANGUAGE.match(attribute(rest, ("lang",)) or "")
                    self.language = found[0] if found else None
            elif close:
                pass
            elif name in LINKS:
                target = attribute(rest, ("href", "src"))
                if target is not None:
                    self.links.append((name, target))
            elif name in RAW:
                self._say(" ", False)
                at = self._skip(name, at, last, unclosed)
            elif name in HIDDEN and not (name == "svg" and rest.endswith("/")):
                self._say(" ", False)
                hidden, depth = name, 1
        self._say(page[at:], bool(hidden))

    def _skip(self, name: str, at: int, last: int, unclosed: set[str]) -> int:
        """Where the content of a raw element ends; an element that isn't closed takes the rest."""
        m = None if name in unclosed else _END[name].search(self.page, at, last + 1)
        if m is None:
            unclosed.add(name)
        return m.end() if m else len(self.page)

    def _title(self, close: str, at: int, last: int, unclosed: set[str]) -> None:
        if close:
            self._titled = False
        elif self.title is None and "title" not in unclosed:
            if _END["title"].search(self.page, at, last + 1):
                self.title, self._titled = "", True
            else:
                unclosed.add("title")


_PLAIN = re.compile(r"/[\w,%+=~./-]*+", re.ASCII)


class Links:
    """Makes the targets of a page's links absolute; one that can't be stays as written."""

    def __init__(self, base: str | None):
        self.base = base or ""
        try:
            self.root = urljoin(self.base, "/")[:-1]
        except ValueError:
            self.root = None

    def absolute(self, target: str) -> str:
        target = unescaped(target).strip()
        # A plain path from the root needs no parsing.
        if self.root is not None and _PLAIN.fullmatch(target) and "//" not in target and "/." not in target:
            return self.root + target
        try:
            return urljoin(self.base, target)
        except ValueError:
            return target
