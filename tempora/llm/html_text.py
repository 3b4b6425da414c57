"""Text blocks of an HTML page, tolerant of unclosed and malformed markup."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Comments, declarations and tags; quoted attribute values may hold '>'.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that do not end a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
ASIDE = frozenset("nav aside footer form menu dialog button select noscript template svg math object canvas audio video map head datalist".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status".split())
#: Parts of class names and ids, between - and _, that tell what is not main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidenav rail footer masthead topbar toolbar cookie cookies consent gdpr notice notification popup modal overlay lightbox newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations widget pagination pager skip".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Block(NamedTuple):
    """A line of text; whether it is main text by its place, set aside by its place, and how much of it is link text."""

    text: str
    main: bool
    aside: bool
    linked: int


def attributes(raw: str) -> dict[str, str]:
    out = {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] for m in ATTRIBUTE.finditer(raw)}
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", raw), re.I):
        out["hidden"] = ""
    return out


def set_aside(name: str, raw: str, in_main: bool) -> bool:
    """Whether an element is by its name or attributes no part of the main text."""
    if name in ASIDE or (name == "header" and not in_main):
        return True
    if not raw or name in ("html", "body", "main"):
        return False
    at = attributes(raw)
    if "hidden" in at or at.get("aria-hidden") == "true" or HIDDEN.search(at.get("style", "")) or at.get("role", "").lower() in ASIDE_ROLES:
        return True
    for label in f"{at.get('class', '')} {at.get('id', '')}".split():
        words = re.split(r"[-_:]+", CAMEL.sub("-", label).lower())
        if ASIDE_WORDS.intersection(words) and "no" not in words and "without" not in words and "has" not in words and "with" not in words:
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space folded, character references decoded; raw elements are left out."""
    parts: list[tuple] = []  # ("text", text) | ("open", name, raw) | ("close", name)
    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            parts.append(("text", page[at:]))
            break
        if m.start() > at:
            parts.append(("text", page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            parts.append(("text", html.escape(m[0][9:].removesuffix("]]>"))))
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            parts.append(("close", name))
            continue
        raw = m[3] if m[2] else m[6]
        parts.append(("open", name, raw or ""))
        if name in RAW and not (raw or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*/?\s*>", re.I).search(page, at)
            at = end.start() if end else (n if name in ("script", "style") else at)
    last_main = max((i for i, p in enumerate(parts) if p[0] == "open" and p[1] in ("article", "main")), default=-1)
    ends = _ends(parts)
    out: list[Block] = []
    line: list[str] = []
    linked = 0
    own = (False, False)  # whether the line is main text, and set aside
    skip_until = main_until = link_until = -1

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(Block(text, *own, linked))
        line.clear()
        linked = 0

    for i, p in enumerate(parts):
        if p[0] == "text":
            if not raw_at(parts, i):
                here = (i < main_until, i < skip_until)
                if here != own:
                    if line:
                        flush()
                    own = here
                line.append(p[1])
                if i < link_until:
                    linked += len(p[1].strip())
            continue
        name = p[1]
        if name not in INLINE and line:
            flush()
        if p[0] == "open":
            end = ends.get(i, i)
            if name == "a":
                link_until = max(link_until, end)
            elif name in ("article", "main") and i >= skip_until and not set_aside(name, p[2], i < main_until):
                main_until = max(main_until, end)
                continue
            if i >= skip_until and set_aside(name, p[2], i < main_until) and (end < len(parts) or i > last_main):
                skip_until = end
    if line:
        flush()
    return out


def raw_at(parts: list[tuple], i: int) -> bool:
    """Whether part i is the content of a raw element."""
    return i > 0 and parts[i - 1][0] == "open" and parts[i - 1][1] in RAW


def _ends(parts: list[tuple]) -> dict[int, int]:
    """Where each opened element ends: at its closing tag, at that of an element around it, or past the end."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}
    for i, p in enumerate(parts):
        if p[0] == "open":
            name = p[1]
            if name in VOID or p[2].rstrip().endswith("/") and name in RAW | {"svg"}:
                out[i] = i
                continue
            if name in CLOSES_P and depth.get("p") and stack[-1][0] == "p":
                _, was = stack.pop()
                depth["p"] -= 1
                out[was] = i
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                _, was = stack.pop()
                depth[name] -= 1
                out[was] = i
            stack.append((name, i))
            depth[name] = depth.get(name, 0) + 1
        elif p[0] == "close" and depth.get(p[1]):
            while stack:
                name, was = stack.pop()
                depth[name] -= 1
                out[was] = i
                if name == p[1]:
                    break
    for _, was in stack:
        out[was] = len(parts)
    return out
