"""Main text of web pages by the distribution of text over lines.

1. Markup is stripped: every block element starts a new line; inline markup vanishes; references are decoded and
   white space becomes one space.  Lines inside menus, headers, footers, sidebars, notices, adverts and reader
   comments are surroundings, by element, role and the names in class and id, and so are forms, but for those around
   the article, all of it, or most of an unmarked page; scripts, styles and the like leave no line at all.
2. Surroundings are left out.  Every other line gets the sum of text lengths over a sliding window of lines; lines
   that are mostly links count nothing.
3. A surge is where the sum rises over the limit, a dive where it falls to nothing.  Where the page marks its
   article the limit is one character, as everything inside the mark is wanted.  The lines of every stretch between
   a surge and the next dive are kept.

A null or empty page, and a page without text, gives an empty text.  A page is handled alone in one pass over its
characters, so repeated pages and null keys are no special case.  An unclosed advert ends where its parent ends or
an article begins; an unfinished tag at the end of a page is dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from dossierflow.llm import texts

WINDOW = 3
SURGE = 80  # characters within a window, where nothing marks the article

# Elements by their part in a page.
SILENT = set("script style noscript template svg math iframe object canvas audio video select option textarea title head".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
AROUND = set("nav footer aside menu dialog button header".split())
MAIN = set("article main".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class and id, and roles, that mark surroundings; and what may stand before and behind the words.
AROUND_WORDS = set(
    "ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond"
    " share sharing sidebar signup skip social sponsor sponsored subscribe topbar widget widgets".split()
)
BEFORE = set("bottom global main page primary secondary site top".split())
BEHIND = set("area bar block box button buttons link links list posts section slot".split())
AROUND_ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!|;|$)")
WORD = re.compile(r"[^\W\d_]{2,}")
COMMENT = re.compile(r"comments?(?:[-_](?:body|content|item|text|wrap|\d+))*")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    around: bool
    main: bool
    form: bool


class Open(NamedTuple):
    name: str
    around: bool
    silent: bool
    main: bool
    form: bool
    at: int


def ended(page: str) -> set[int]:
    """Where start tags stand that have an end tag of their own."""
    found: set[int] = set()
    waiting: dict[str, list[int]] = {}
    at = 0
    while m := TAG.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if (m[1] if m[2] else m[4]) == "/":
            if waiting.get(name):
                found.add(waiting[name].pop())
        elif name in RAW:
            end = CLOSING[name].search(page, at)
            at = end.start() if end else len(page)
        elif name not in VOID:
            waiting.setdefault(name, []).append(m.start())
    return found


def role_of(attributes: str) -> str:
    return next(("".join(values).strip().lower() for key, *values in ATTRIBUTE.findall(attributes) if key.lower() == "role"), "")


def names_surroundings(token: str) -> bool:
    """Whether a name in class or id says surroundings as a whole: ``site-header``, but not ``has-sidebar``."""
    words = WORD.findall(token)
    while words and words[0] in BEFORE:
        del words[0]
    while words and words[-1] in BEHIND:
        del words[-1]
    return bool(words) and AROUND_WORDS.issuperset(words)


def marks(name: str, attributes: str) -> bool:
    """Whether an element is part of the surroundings by what it says about itself."""
    if not attributes.strip() or name in ("html", "body"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        # An article is not called by its surroundings, but a reader's comment may be one.
        if key in ("class", "id") and any(map(COMMENT.fullmatch if name in MAIN else names_surroundings, value.split())):
            return True
        if key == "role" and value.strip() in AROUND_ROLES:
            return True
        if key == "hidden" and value.strip() != "until-found" or key == "style" and HIDDEN.search(value):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The page's lines of text in order."""
    out: list[Line] = []
    stack = [Open("", False, False, False, False, 0)]
    with_end: set[int] | None = None
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    opened: Counter[str] = Counter()  # names on the stack

    def end_line():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, min(linked, len(text)), stack[-1].around, stack[-1].main, stack[-1].form))
        parts.clear()
        linked = 0

    def say(piece: str):
        nonlocal linked
        if piece and not stack[-1].silent:
            parts.append(piece)
            linked += len(piece) if links else 0

    while True:
        m = TAG.search(page, at)
        say(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or not m[0].endswith(">"):
            continue
        closing, attributes = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if name == "br":
            say(" ")
        elif name in VOID:
            if name in BLOCK:
                end_line()
        elif closing:
            depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name) if opened[name] else 0
            if name == "a":
                links = max(0, links - 1)
            if depth:
                if name in BLOCK or any(o.name in BLOCK or o.around != stack[depth - 1].around for o in stack[depth:]):
                    end_line()
                opened.subtract(o.name for o in stack[depth:])
                del stack[depth:]
            elif name in BLOCK:
                end_line()
        else:
            if name in BLOCK:
                end_line()
                links = 0
            if name == "a":
                links += 1
            if name in MAIN and stack[-1].around and not stack[-1].main:
                with_end = ended(page) if with_end is None else with_end
                stack = [o for o in stack if not o.around or o.at in with_end]  # without surroundings that nobody closed
                opened = Counter(o.name for o in stack)
            top = stack[-1]
            if name in ("p", "li", *HEADINGS) and top.name in ("p", *HEADINGS) or name == "li" and top.name == "li":
                opened[stack.pop().name] -= 1  # its end tag may be left out
                top = stack[-1]
            around = top.around or name in AROUND or marks(name, attributes)
            if top.main and name in HEADINGS and top.name == "header":
                around = False  # the headline of the article
            if around and not top.around:
                end_line()
            main = top.main or (name in MAIN or "role" in attributes.lower() and role_of(attributes) == "main") and not around
            form = (top.form or name == "form") and top.main >= main  # not of an article inside the form
            opened[name] += 1
            stack.append(Open(name, around, top.silent or name in SILENT, main, form, m.start()))
            if name in RAW:
                end = CLOSING[name].search(page, at)
                at = end.start() if end else len(page)
    end_line()
    return out


def kept(found: list[Line]) -> list[str]:
    """Text between surges and dives."""
    found = [x for x in found if not x.around]
    marked = any(x.main for x in found)
    found = [x for x in found if x.main >= marked]
    weigh = lambda x: len(x.text) * (marked or 2 * x.linked <= len(x.text))
    inside, outside = (sum(weigh(x) for x in found if x.form == form) for form in (True, False))
    if outside and (marked or inside <= outside):
        found = [x for x in found if not x.form]
    weight = list(map(weigh, found))
    limit = 1 if marked else SURGE
    out: list[str] = []
    start = -1
    for i in range(len(found) + 1):
        window = sum(weight[i : i + WINDOW])
        if start < 0 and window >= limit and i < len(found) and weight[i]:
            start = i  # surge, with the title and the like that stand right before it
            while not marked and start and weight[start - 1]:
                start -= 1
        if start >= 0 and window == 0:  # dive
            out += [x.text for x in found[start:i]]
            start = -1
    return out or [x.text for x, w in zip(found, weight) if w]  # a page of few words


def main_text(page: str) -> str:
    return "\n".join(kept(lines(page)))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches, column):
            found = [main_text(s.text(i).decode("utf-8", "replace")) for i in range(len(s))]
            of = lambda name: s.batch.column(s.batch.schema.get_field_index(name))
            yield pa.record_batch([of(key), of(url), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, column).mapInArrow(run, f"{key} {kind}, {url} string, text string, n_chars long")
