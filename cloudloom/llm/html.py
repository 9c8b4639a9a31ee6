"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each stretch between block-level tags. Lines that tags, roles or whole names mark as
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments have weight 0; any other line weighs its
characters outside links. The weights are summed over sliding windows of WINDOW lines (a line and its neighbours). The level of a
page is LEVEL times the mean of its sums above 0. Text surges where the sum rises above the level and dives where it falls to it
again; another article element is a dive too. Of the blocks between surge and dive the one with the most text is the core.

The core's lines of more than a window's share of the level carry it, and so do sentences beside them, as far as the sum stays
above 0. What they share of the page is the main text: the innermost article or main element that holds them, else the
innermost element, or its parent if that holds another such block beside a break. The text there that is not marked is kept
whole, so short paragraphs and parts after a break stay; the same rule leaves out what lies below the level elsewhere.

A null html counts as empty; a page with no text gives an empty text. Of blocks with equal text the first is the core. Pages are
read in time linear in their length, also broken ones. Rows are independent; repeated rows give repeated results. An empty table
gives no rows. Only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import itertools
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.common import mapped, slices, table

WINDOW, LEVEL = 3, 0.5
#: Fixed values of HTML.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST_OF_TAG = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+|\"[^\"]*+\"|'[^']*+'")
RAW = frozenset("script style noscript template textarea select svg iframe object title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a block-level tag ends if they are open.
CLOSED_BY_BLOCK = frozenset(["p"])
OUT = frozenset("head nav header footer aside form button dialog menu fieldset input option datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A name (a word of class, or an id) marks an element if it is one of these, or several joined, also with words of place and kind.
OUT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices disclaimer alert alerts popup modal overlay sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond reply replies share sharing social newsletter subscribe subscription signup login related recommended recommendations pagination pager widget widgets toolbar skip".split())
PLACES = frozenset("site main page top bottom left right side box block bar container wrapper wrap list item items button buttons link links area section inner outer global primary secondary content posts post articles thread form text sticky mobile desktop slot unit entry icons icon media js id".split())
#: What marks an article element is narrower: an article may be about anything.
ARTICLE_OUT = frozenset("comment comments reply related teaser ad promo sponsored".split())
SENTENCE = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


def marked(name: str) -> bool:
    """Whether a whole name is of boilerplate: side-effects and share-price are not, side-bar and share-buttons are."""
    parts = [p for p in re.split(r"[_-]+", name.lower()) if p and not p.isdigit()]
    return any(p in OUT_NAMES for p in parts) and all(p in OUT_NAMES or p in PLACES for p in parts)


def left_out(tag: str, attributes: str) -> bool:
    if tag in OUT:
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.strip().lower() in OUT_ROLES:
            return True
        if name in ("class", "id"):
            names = value.split()
            if tag == "article" and any(n.lower() in ARTICLE_OUT for n in names) or tag not in ("body", "html", "main", "article") and any(map(marked, names)):
                return True
    return False


def tokens(html: str):
    """(text before, tag, whether it closes, attributes) for each tag, and what is left with a tag of None. Comments, declarations and raw elements are an empty tag.

    A quote in a tag may hide its end; where it would hide the rest of the page, quotes count for nothing from there on."""
    at, last, quotes = 0, html.rfind(">"), True
    while True:
        i = html.find("<", at)
        while 0 <= i < last and not (TAG.match(html, i) or html[i + 1 : i + 2] in ("!", "?")):
            i = html.find("<", i + 1)
        if i < 0 or i > last and not html.startswith("<!--", i):
            break
        before = html[at:i]
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = len(html) if end < 0 else end + 3
            yield before, "", False, ""
            continue
        m = TAG.match(html, i)
        if m is None:
            at = html.find(">", i) + 1
            yield before, "", False, ""
            continue
        tail = REST_OF_TAG.match(html, m.end()) if quotes else None
        if tail is None:
            quotes = False
            at = html.find(">", m.end()) + 1
            attributes = html[m.end() : at - 1]
        else:
            at, attributes = tail.end(), tail[1]
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            yield before, "", False, ""
            continue
        yield before, tag, bool(m[1]), attributes
    rest = html[at:]
    yield (rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^<>]*\Z", rest) else rest), None, False, ""


def lines_of(html: str) -> list[tuple]:
    """Text, length outside links, the innermost open element and whether it is left out, for each line with text."""
    lines: list[tuple] = []
    stack: list[tuple] = []  # tag, number (below 0: article or main), left out, the element
    open_count: dict[str, int] = {}
    parts: list[str] = []
    state = {"number": 0, "links": 0, "linked": 0}

    def end_line():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - state["linked"]), stack[-1][3] if stack else None, bool(stack) and stack[-1][2]))
            parts.clear()
        state["linked"] = 0

    def text(s: str):
        if s:
            parts.append(s)
            if state["links"]:
                state["linked"] += len(s)

    def shut(k: int):
        end_line()
        for entry in stack[k:]:
            open_count[entry[0]] -= 1
        del stack[k:]

    for before, tag, closes, attributes in tokens(html):
        text(before)
        if tag is None:
            break
        if not tag:
            parts.append(" ")
            continue
        if tag in INLINE and not (not closes and left_out(tag, attributes)):
            if tag == "a":
                state["links"] = 0 if closes else 1
            if closes and stack and stack[-1][0] == tag:  # an inline element that was left out
                shut(len(stack) - 1)
            continue
        if closes:
            if open_count.get(tag):
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            else:
                end_line()
            continue
        end_line()
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK and tag not in INLINE:
            shut(len(stack) - 1)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] in (tag, *(("dt", "dd") if tag in ("dt", "dd") else ()), *(("td", "th") if tag in ("td", "th") else ())):
            shut(len(stack) - 1)
        state["number"] += 1
        out = stack[-1][2] if stack else False
        kind = state["number"] if tag not in ("article", "main") else -state["number"]
        up = stack[-1][3] if stack else None
        stack.append((tag, kind, out or left_out(tag, attributes), (up, kind, (up[2] if up else 0) + 1)))
        open_count[tag] = open_count.get(tag, 0) + 1
        state["links"] = 0
    end_line()
    return lines


def window_sums(weights: list[int], breaks: list[bool], window: int = WINDOW) -> list[int]:
    """For each line the sum of the window around it. breaks: whether a line begins anew, so that no window reaches from it back."""
    sums, near = [], window // 2
    start = 0
    for i in range(1, len(weights) + 1):
        if i == len(weights) or breaks[i]:
            part = weights[start:i]
            total = [0, *itertools.accumulate(part)]
            sums += [total[min(len(part), k + near + 1)] - total[max(0, k - near)] for k in range(len(part))]
            start = i
    return sums


def runs(sums: list[int], above: float, breaks: list[bool]) -> list[tuple[int, int]]:
    """First and last line of each stretch between a surge above the level and the next dive."""
    found, begin = [], None
    for i, s in enumerate(sums):
        if begin is not None and (s <= above or breaks[i]):
            found.append((begin, i - 1))
            begin = None
        if begin is None and s > above:
            begin = i
    return found + ([(begin, len(sums) - 1)] if begin is not None else [])


def level_of(sums: list[int]) -> float:
    some = [s for s in sums if s > 0]
    return LEVEL * sum(some) / len(some) if some else 0.0


def meeting(a, b):
    """The innermost element that holds both; an element is (its parent, its number, its depth)."""
    while a is not b:
        if a is None or b is None:
            return None
        if a[2] >= b[2]:
            a, b = a[0], b if a[2] > b[2] else b[0]
        else:
            b = b[0]
    return a


def inside(element, other) -> bool:
    while other is not None and other[2] > element[2]:
        other = other[0]
    return other is element


def article_of(element):
    """The innermost article or main element around it."""
    while element is not None and element[1] > 0:
        element = element[0]
    return element


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    weights = [0 if out else n for _, n, _, out in lines]
    articles, breaks, before = [article_of(e) for _, _, e, _ in lines], [], None
    for a, (_, n, _, out) in zip(articles, lines, strict=True):
        breaks.append(before is not None and not out and n > 0 and a is not None and a is not before[0] and before[0] is not None and not inside(a, before[0]) and not inside(before[0], a))
        if not out and n:
            before = (a,)
    sums = window_sums(weights, breaks)
    level = level_of(sums)
    blocks = runs(sums, level, breaks)
    if not blocks:
        return ""
    core = max(blocks, key=lambda b: sum(weights[b[0] : b[1] + 1]))

    def holder(first: int, last: int):
        """What the lines that carry a block share, and how many they are."""
        carrying = [lines[i][2] for i in range(first, last + 1) if weights[i] > level / WINDOW]
        out = carrying[0]
        for e in carrying[1:]:
            out = meeting(out, e)
        return out, len(carrying)

    common, carried = holder(*core)
    around = next((r for r in runs(sums, 0, breaks) if r[0] <= core[0] <= r[1]), core)
    if article_of(common) is not None:
        common = article_of(common)
    else:
        for i in range(around[0], around[1] + 1):  # sentences beside the core
            if weights[i] and weights[i] <= level / WINDOW and SENTENCE.search(lines[i][0]) and common is not None and not inside(common, lines[i][2]):
                common, carried = meeting(common, lines[i][2]), carried + 1
        if carried == 1 and common is not None:
            common = common[0]  # a lone paragraph: what its parent holds
        if common is not None and (parent := common[0]) is not None and article_of(parent) is None:  # a break in the text: what the parent holds, if it holds another block
            for block in blocks:
                other = holder(*block)[0] if block != core else common
                if other is not None and not inside(common, other) and inside(parent, other):
                    common = parent
                    break
    return " ".join(t for t, _, e, out in lines if not out and (common is None or inside(common, e)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; no shuffle."""

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


#: What is expected of pages whose article element holds headings, paragraphs, bold text and breaks only, as those of the test tables do.
SQL = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace(replace(replace(
  regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages)
"""
