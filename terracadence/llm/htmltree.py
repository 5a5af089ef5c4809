"""Web pages as trees of blocks, and repeated siblings folded into groups."""

from __future__ import annotations

import html
import re
from functools import lru_cache

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: The end tag of elements whose content is no markup.
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of a text, whatever is around them.
SILENT = frozenset("head script style noscript template iframe object embed svg math canvas audio video map select option datalist button textarea title xmp noembed noframes dialog".split())
NOISE_TAGS = frozenset("nav aside footer form menu search fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs captcha comment comments commentlist complementary contentinfo consent cookie cookies disqus footer gdpr hidden login masthead"
    " menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup print promo promos promoted promotion recommendations recommended related replies reply respond search share sharing sidebar sidebars"
    " signup skip social sponsor sponsored subscribe subscription tags toolbar tooltip widget widgets".split()
)
#: Repeated siblings of these tags are one list, whatever they hold.
LEAVES = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
#: Blocks nested deeper than this become siblings, and longer units of repetition are not looked for; no text is lost.
DEEPEST, LONGEST_UNIT = 150, 8


@lru_cache(maxsize=65_536)
def element_key(tag: str, attributes: str) -> str:
    """The tag with the words of class, id and role, numbers left out; hidden elements get the word."""
    if not attributes:
        return tag
    words = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name in ("class", "id", "role", "itemprop"):
            words.update(re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
        elif name == "hidden" or (name, value.lower()) == ("aria-hidden", "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            words.add("hidden")
    return ".".join([tag, *sorted(words)])


@lru_cache(maxsize=65_536)
def marks(key: str) -> tuple[str, frozenset[str], bool, bool]:
    """Tag, words, whether the element never holds text, whether it is noise within or beside a text."""
    tag, *words = key.split(".")
    words = frozenset(words)
    return tag, words, tag in SILENT, tag in NOISE_TAGS or bool(words & NOISE_WORDS)


def parse(page: str) -> list:
    """The page as items: ["E", key, items] for blocks and for inline elements that are silent or noise, ["T", text, link characters] for text between block borders.

    Unclosed and stray tags are tolerated as browsers do for paragraphs, lists and tables. White space becomes one
    space; text of white space alone is no item.
    """
    root: list = []
    stack: list = [("", root, 0)]
    text: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                stack[-1][1].append(["T", joined, min(linked, len(joined))])
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece)

    def close(tags, stops=frozenset()) -> None:
        """End the outermost open element of these tags that lies above any stop."""
        upto = 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in stops:
                break
            if stack[depth][0] in tags:
                upto = depth
        if upto:
            flush()
            del stack[upto:]

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if not 0 <= start < last:
            add(page[at:])
            break
        found = TOKEN.match(page, start)
        if not found:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = found.end()
        if found.group(2) is None:
            if found.group().startswith("<![CDATA["):
                add(found.group()[9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = found.group(2).lower(), found.group(1), found.group(3)
        if closing:
            if tag == "a":
                in_link = False
            elif tag == "br":
                text.append(" ")
            else:
                if tag in BLOCK:
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        flush()
                        del stack[depth:]
                        break
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else n
            if tag not in SILENT:
                continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link = True
        block = tag in BLOCK or "-" in tag
        key = element_key(tag, attributes)
        _, _, silent, noise = marks(key)
        if not (block or silent or noise):
            continue
        if block:
            if tag in CLOSES:
                close(CLOSES[tag], STOPS[tag])
            elif any(name == "p" for name, *_ in stack[-8:]):
                close({"p"}, {"td", "th", "li", "dd", "div", "section", "article", "blockquote", "table"})
            in_link = in_link and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div")
        flush()
        _, items, depth = stack[-1]
        if attributes.endswith("/"):
            continue
        if depth < DEEPEST or ((silent or noise) and depth < 2 * DEEPEST):
            node = ["E", key, []]
            items.append(node)
            stack.append((tag, node[2], depth + 1))
        else:
            stack.append((tag, items, depth))
    flush()
    return root
