"""Leaf blocks of a web page: one tolerant pass over the markup, text and tag path of each block."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Elements that end a block (fixed values, from the HTML standard's flow elements).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content (fixed values).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page (fixed values).
SKIPPED_TAGS = frozenset("script style template noscript title iframe svg math object canvas textarea select audio video".split())
#: Those whose content is raw text: the first end tag ends them.
_RAW = frozenset("script style noscript title iframe textarea".split())
#: Those that a "/" before ">" closes; anywhere else it means nothing.
_FOREIGN = frozenset(("svg", "math"))
#: What an opening tag closes first, if it is open and nothing of the second set is in between.
_IMPLIED = {
    **dict.fromkeys(("li",), ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("tr",), ({"tr"}, {"table"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"})),
}
_BREAKS_P = BLOCK_TAGS - {"label", "button", "option"}
#: Elements that may stand in a head; any other one, or text, ends it.
_IN_HEAD = frozenset("html head title base link meta style script noscript template".split())
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # attributes: a name, then perhaps "=" and a value; quotes count only where a value begins
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++|(?=>)))?+|=)*+|[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Path:
    """An open element with the names from its class, id and role, and the path above it.

    Paths share what is above them, so a page of any depth takes linear time.
    """

    __slots__ = ("above", "tag", "names", "depth", "kept")

    def __init__(self, above: Path | None, tag: str, names: tuple[str, ...]):
        self.above, self.tag, self.names = above, tag, names
        self.depth: int = 1 + (above.depth if above else 0)
        self.kept: object = None  # room for what a reader derives from the path


class Block(NamedTuple):
    """A leaf block: its path (None: outside of all elements), its text, and its characters in links."""

    path: Path | None
    text: str
    link_chars: int


def _names(attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return ()
    out = []
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        out += [w for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()) if w]
    return tuple(out)


def _end_of(tag: str, page: str, at: int) -> int:
    """Where a skipped element ends whose start tag ends at ``at``; equal elements within it are counted, but in raw text."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?![\w-])[^>]*>?", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag not in _RAW and not (tag in _FOREIGN and m[0].endswith("/>")):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def parse(page: str) -> list[Block]:
    """All blocks with text, in page order.

    Character references are decoded, white space within a block becomes one space, and
    blocks are trimmed.  Broken markup is read as far as it goes: an end tag without a start
    is passed over, what is open at the end is closed there.
    """
    blocks: list[Block] = []
    stack: list[Path] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    in_link, link_chars, at, n = False, 0, 0, len(page)
    in_head = False

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append(Block(stack[-1] if stack else None, text, min(link_chars, len(text))))
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars, in_head
        if in_head and raw and not raw.isspace():
            in_head = False
        if raw and not in_head:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                link_chars += len(text)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a lone "<" is text, an unfinished tag at the end is not
            if re.match(r"</?[A-Za-z]", page[start : start + 3]) and page.find(">", start) < 0:
                add(page[at:start])
                break
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            in_head = not m["end"]
            continue
        if in_head and not m["end"] and tag not in _IN_HEAD:
            in_head = False
        if tag in SKIPPED_TAGS:
            if not m["end"] and not (tag in _FOREIGN and m["attrs"].endswith("/")):
                at = _end_of(tag, page, at)
            continue
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag == "hr":
            continue
        if m["end"]:
            if open_tags[tag]:
                while (closed := stack.pop().tag) != tag:
                    open_tags[closed] -= 1
                open_tags[tag] -= 1
            continue
        in_link = False
        if tag in _BREAKS_P and stack and stack[-1].tag == "p":
            open_tags[stack.pop().tag] -= 1
        if tag in _IMPLIED and any(open_tags[t] for t in _IMPLIED[tag][0]):
            closes, stops = _IMPLIED[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in closes:
                    open_tags.subtract(p.tag for p in stack[k:])
                    del stack[k:]
                    break
        open_tags[tag] += 1
        stack.append(Path(stack[-1] if stack else None, tag, _names(m["attrs"])))
    flush()
    return blocks
