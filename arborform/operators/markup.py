"""The markup scanner of B1: a page's tokens in one pass, linear in the page.

The tokens are those of ``MARKUP_PATTERN`` (which the SQL oracle reads as a
regular expression). A backtracking search for that pattern looks to the end of
the page for every start that nothing closes. The scanner looks for a closer
only as long as one can be left: once a search has come to the end without one,
that kind of closer is not looked for again. Where a tag with quoted '>' ends is
known for every place from one pass from the right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

BLANK_CHARS = " \t\n\r\f\u000b"

# The markup token pattern and the default nesting tags.
# Raw blocks (script, style), comments and declarations are single tokens so
# that tags written inside them are not read as structure; a '>' inside a quoted
# attribute does not end a tag.
MARKUP_PATTERN = (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
                  r"|<!--.*?-->|<![^>]*>|</?[a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[a-z][^>]*>|[^<]+|<")
RAW_PATTERN = r"(?is)^<(script|style)\b.*</(script|style)\s*>$"
TAG_NAME_PATTERN = r"^</?([A-Za-z][A-Za-z0-9]*)"
NEST_TAGS = ("html", "head", "title", "body", "nav", "ul", "li", "a", "div",
             "article", "footer", "h1")

_RAW_START = re.compile(r"(?i)<(?:(script)|style)\b")
_RAW_END = {True: re.compile(r"(?i)</script\s*>"), False: re.compile(r"(?i)</style\s*>")}
_RAW = re.compile(RAW_PATTERN)
_TAG_START = re.compile(r"(?i)</?[a-z]")
_NAME = re.compile(TAG_NAME_PATTERN)
_MARK = re.compile("[\"'>]")


class Scanner:
    """Tokens of one page as (text, kind): kind is ``text``, ``raw``, ``tag`` or
    ``skip`` (comments and declarations)."""

    def __init__(self, page: str):
        self.page = page
        self.gone = set()               # closers that no longer occur
        self.tag_end = None             # place -> end of a tag that is outside quotes there

    def after(self, closer: str, start: int) -> int:
        """End of the next ``closer`` from ``start`` on; -1 if there is none."""
        if closer in self.gone:
            return -1
        at = self.page.find(closer, start)
        if at < 0:
            self.gone.add(closer)
            return -1
        return at + len(closer)

    def raw_end(self, start: int) -> int:
        """End of a script or style block that begins at ``start``, or -1."""
        found = _RAW_START.match(self.page, start)
        if not found:
            return -1
        kind = _RAW_END[bool(found[1])]
        if kind in self.gone:
            return -1
        opened = self.after(">", found.end())
        if opened < 0:
            return -1
        closed = kind.search(self.page, opened)
        if not closed:
            self.gone.add(kind)
            return -1
        return closed.end()

    def quoted_end(self, start: int) -> int:
        """End of the first '>' outside quotes, reading from ``start`` (outside);
        -1 if there is none or a quote stays open before it."""
        if self.tag_end is None:
            self.marks = [m.start() for m in _MARK.finditer(self.page)]
            ends, later = [-1] * (len(self.marks) + 1), {'"': len(self.marks), "'": len(self.marks)}
            for i in range(len(self.marks) - 1, -1, -1):
                c = self.page[self.marks[i]]
                if c == ">":
                    ends[i] = self.marks[i] + 1
                else:                   # on to what follows the closing quote
                    close = later[c]
                    ends[i] = ends[close + 1] if close < len(self.marks) else -1
                    later[c] = i
            self.tag_end, self.at = ends, 0
        while self.at < len(self.marks) and self.marks[self.at] < start:
            self.at += 1                # starts only grow
        return self.tag_end[self.at]

    def tokens(self) -> Iterator[tuple[str, str]]:
        page, here = self.page, 0
        while here < len(page):
            if page[here] != "<":
                start = page.find("<", here)
                end, kind = (start if start >= 0 else len(page)), "text"
            else:
                end, kind = self.raw_end(here), "raw"
                if end < 0 and page.startswith("<!", here):
                    end, kind = (self.after("-->", here + 4) if page.startswith("<!--", here) else -1), "skip"
                    end = self.after(">", here + 2) if end < 0 else end
                elif end < 0:
                    tag = _TAG_START.match(page, here)
                    end, kind = (self.quoted_end(tag.end()) if tag else -1), "tag"
                    end = self.after(">", tag.end()) if tag and end < 0 else end
                if end < 0:
                    end, kind = here + 1, "text"
            token = page[here:end]
            if kind == "tag" and _RAW.match(token):     # a closer inside the tag itself
                kind = "raw"
            yield token, kind
            here = end


def markup_walk(page: str, tags: frozenset) -> tuple[list[tuple[str, int, int]], int, int]:
    """Leaves (token, depth, sib) of one page, stray closes, unclosed opens.

    Nesting tags make nodes; text, raw blocks and self-closed nesting tags are
    leaves; comments, declarations, blank text and other tags are passed over. A
    close tag ends the latest open tag of its name and those inside it; without
    one it is passed over (a stray close). What is open at the end ends there.
    Time is linear: a tag is opened and ended once, and open places are counted
    by name.
    """
    leaves, path, top, stray, open_ = [], [], 0, 0, {}      # path: [name, sib, token, children]

    def place() -> int:
        nonlocal top
        if path:
            path[-1][3] += 1
            return path[-1][3] - 1
        top += 1
        return top - 1

    def end() -> str:
        name, sib, token, children = path.pop()
        open_[name] -= 1
        if not children:
            leaves.append((token, len(path), sib))
        return name

    for token, kind in Scanner(page).tokens():
        if kind == "skip":
            continue
        found = _NAME.match(token) if kind == "tag" else None
        name = found[1].lower() if found else ""
        if name and name not in tags:
            continue
        if name and token.startswith("</"):
            if open_.get(name):
                while end() != name:
                    pass
            else:
                stray += 1
        elif name and not token.endswith("/>"):
            path.append([name, place(), token, 0])
            open_[name] = open_.get(name, 0) + 1
        elif name or token.strip(BLANK_CHARS):
            leaves.append((token, len(path), place()))
    unclosed = len(path)
    while path:
        end()
    if not leaves:
        leaves.append((page, 0, 0))                     # a page without nodes is its own leaf
    return leaves, stray, unclosed
