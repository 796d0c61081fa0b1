"""Text lines of a web page, from its markup alone: a small helper for one page, without Spark.

Markup is read as browsers do where it matters for text: comments, raw-text elements, quoted attributes, implied ends of
paragraphs and list items, ends that match nothing.  Text between the starts and ends of block elements is one line.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

_TAG = re.compile(r"""<(?:(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|!--(?P<note>)|[!?/][^>]*>)""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?<![^\s"'/])class\s*=\s*["']?([\w-]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMENT_END = re.compile(r"--!?>")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold no article text.
_CHROME = frozenset("head nav footer aside form dialog menu search noscript template svg math object canvas audio video select button".split())
#: Words of class, id or role that say the same of any element.
_CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers masthead topbar toolbar comment comments disqus respond related recommended share sharing social newsletter subscribe signup login contentinfo complementary".split())
_HEADER_WORDS = frozenset(("header", "headers"))
#: Words before one of the above that make it a remark about the layout, and words with which a header heads an article.
_LAYOUT = frozenset("has with no without".split())
_TITLED = frozenset("article post entry story content main section".split())
#: An open element of the second kind ends where the first starts, up to the nearest of the third.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_NOT_IN_P = _BLOCK - {"body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "legend"}


class Line(NamedTuple):
    text: str
    chrome: bool  # in an element that holds no article text
    inside: int  # 2 in an article, 1 in a main element, 0 elsewhere
    slot: str  # for chrome, the elements that it is in, from the outermost chrome on


def _named_chrome(attrs: str, in_main: bool) -> bool:
    for key, *values in _ATTR.findall(attrs):
        for token in "".join(values).split():
            words = [w.lower() for w in _WORD.findall(token)]
            for i, word in enumerate(words):
                if word in _CHROME_WORDS and not (i and words[i - 1] in _LAYOUT):
                    return True
                if word in _HEADER_WORDS and not in_main and not _TITLED.intersection(words) and not (i and words[i - 1] in _LAYOUT):
                    return True
            if key.lower() == "role" and token.lower() in ("search", "alert", "alertdialog", "form") or key.lower() == "role" and token.lower() == "banner" and not in_main:
                return True
    return False


class _Open(NamedTuple):
    name: str
    chrome: bool
    inside: int
    slot: str
    muted: bool  # in an inline element that holds no article text: what surrounds it is one line


def lines(html: str | None) -> list[Line]:
    """All text lines of a page in order, white space as single spaces; empty for null."""
    out: list[Line] = []
    stack, held = [_Open("", False, 0, "", False)], Counter()
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Line(text, *stack[-1][1:4]))

    def close(place: int) -> None:
        """Ends the open elements from ``place`` on."""
        for x in stack[place:]:
            held[x.name] -= 1
        del stack[place:]

    def last(names: tuple[str, ...], until: tuple[str, ...] = ()) -> int:
        """Place of the innermost open element of ``names`` above any of ``until``; 0 if there is none."""
        if not any(held[n] > 0 for n in names):
            return 0
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].name in names:
                return place
            if stack[place].name in until:
                return 0
        return 0

    html, at = html or "", 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at and not stack[-1].muted:
            parts.append(unescape(html[at:lt]))
        if lt == len(html):
            break
        tag = _TAG.match(html, lt)
        if tag is None:
            if lt + 1 < len(html) and (html[lt + 1].isascii() and html[lt + 1].isalpha() or html[lt + 1] in "!?/"):
                break  # a tag that the page's end cuts off
            if not stack[-1].muted:
                parts.append("<")
            at = lt + 1
            continue
        at = tag.end()
        if tag["note"] is not None:
            end = re.compile(r"-?>").match(html, at) or _COMMENT_END.search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if tag["end"]:
            if place := last((name,)):
                close(place)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            skip = html.find(">", at)
            at = skip + 1 if skip >= 0 else len(html)
            continue
        if name in _VOID:
            continue
        if held["head"] > 0 and name not in ("noscript", "template"):
            close(last(("head",)))
        if name in _NOT_IN_P and (place := last(("p",), ("td", "th", "button", "article", "section", "div", "blockquote", "li"))):
            close(place)
        if name in _ENDS and (place := last(*_ENDS[name])):
            close(place)
        top = stack[-1]
        plain = name in ("html", "body", "main")
        if plain and name != "main" and held[name] > 0:
            continue
        chrome = top.chrome or name in _CHROME or name == "header" and not top.inside or not plain and _named_chrome(tag["attrs"], top.inside > 0)
        inside = 2 if name == "article" else max(top.inside, 1) if name == "main" else top.inside
        slot = f"{top.slot}>{name}{'.'.join(('', *_CLASS.findall(tag['attrs'])))}" if chrome and len(top.slot) < 400 else top.slot
        stack.append(_Open(name, chrome, inside, slot, top.muted or chrome and not top.chrome and name not in _BLOCK))
        held[name] += 1
    flush()
    return out


def article(found: list[Line]) -> tuple[list[int], bool]:
    """(places of the lines that can be article text, whether an article or main element marks them)."""
    scope = max((x.inside for x in found if not x.chrome), default=0)
    return [i for i, x in enumerate(found) if not x.chrome and x.inside >= scope], scope > 0


_NUMBER = re.compile(r"\d+")
#: Parameters that tell how a page was reached or which part of it is shown, not which page it is.
_PASSING = re.compile(r"(utm_\w+|ref|page|fbclid|gclid|msclkid|sid|sessionid|phpsessid)=|\w+$", re.I)


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) that equal pages share: no scheme, fragment, index name, ending or passing parameters; numbers sort by value."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", (url or "").strip()).removeprefix("//").partition("#")[0]
    where, _, query = rest.partition("?")
    host, _, path = where.partition("/")
    path = re.sub(r"(^|/)index\.\w+$|\.(x?html?|php|aspx?|jsp)$", "", path.rstrip("/")).rstrip("/")
    kept = sorted(x for x in query.split("&") if x and not _PASSING.match(x))
    whole = path + ("?" + "&".join(kept) if kept else "")
    return host.rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443"), _NUMBER.sub(lambda m: m[0].zfill(12), whole)


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit-parallel rows of the alignment of ``a`` with ``b``: bit j is 0 where b[j] adds one to the length; the last alone unless ``keep``."""
    full = (1 << len(b)) - 1
    at: dict[int, int] = {}
    bits: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        bits.setdefault(y, []).append(j)
    for y, places in bits.items():
        mask = bytearray((len(b) + 7) // 8)
        for j in places:
            mask[j >> 3] |= 1 << (j & 7)
        at[y] = int.from_bytes(mask, "little")
    row, rows = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(row: int, size: int) -> list[int]:
    """Common lengths with each prefix of b, from the last row."""
    out, n = [0], 0
    for byte in row.to_bytes((size + 7) // 8 or 1, "little"):
        for k in range(8):
            if len(out) <= size:
                n += not byte >> k & 1
                out.append(n)
    return out


def _align(a: list[int], b: list[int], room: int) -> list[bool]:
    """Which of ``a`` are in a longest common subsequence; the rows kept at once take ``room`` bits, longer ones are halved."""
    if not a or not b:
        return [False] * len(a)
    if len(a) > 1 and len(a) * len(b) > room:
        half = len(a) // 2
        left, right = _lengths(_rows(a[:half], b, False)[0], len(b)), _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _align(a[:half], b[:cut], room) + _align(a[half:], b[cut:], room)
    rows, marks, i, j = _rows(a, b, True), [False] * len(a), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                marks[i], j = True, j - 1
    return marks


def shared(a: list[int], b: list[int], room: int = 1 << 26) -> list[bool]:
    """For each line of ``a`` whether a longest common subsequence with ``b`` holds it."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    common = {*a[start : len(a) - end]} & {*b[start : len(b) - end]}
    places = [i for i in range(start, len(a) - end) if a[i] in common]
    marks = [i < start or i >= len(a) - end for i in range(len(a))]
    for i, mark in zip(places, _align([a[i] for i in places], [y for y in b[start : len(b) - end] if y in common], room), strict=True):
        marks[i] = mark
    return marks
