"""Main text of web pages by a maximum-scoring subsequence.

A page is a run of words and tags. Words score one; a tag scores below zero, the more so the more often it stands
outside the article on labelled pages (pages with one ``article`` or ``main`` element serve as labelled). The best
contiguous region, found by one linear scan, is the article. Elements that are never article text (menus, footers,
forms, scripts, adverts, reader comments and the like) score nothing and give no text, wherever they stand.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements by their role in HTML.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("head nav header footer aside form button select menu dialog script style textarea title noscript iframe template svg canvas object".split())
ARTICLE = ("article", "main")
# Words in class, id or role that mark an element as no article text.
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|sidebar|menu|nav(?:bar|igation)?"
                  r"|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|respond|share|sharing|social|related|recommended|complementary|contentinfo)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
# Tags that end an open element in HTML, and the elements that shield it.
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
SCOPE = frozenset("table td th caption object template button".split())
TABLE = frozenset(["table"])
ROWS = frozenset("table caption thead tbody tfoot tr td th".split())
_SHIELD = (ENDS_P | SCOPE | frozenset(["select"])) - frozenset("address div p li dd dt".split())
_CELL, _ROW, _GROUP = (("td", "th", "caption"), TABLE | {"tr"}), (("tr", "caption"), TABLE), (("thead", "tbody", "tfoot", "caption"), TABLE)
ENDS = ({"li": ((("li",), _SHIELD),), "td": (_CELL,), "th": (_CELL,), "tr": (_ROW,), "option": ((("option",), _SHIELD),), "optgroup": ((("option",), _SHIELD), (("optgroup",), _SHIELD))}
        | dict.fromkeys(("dd", "dt"), ((("dd", "dt"), _SHIELD),)) | dict.fromkeys(("thead", "tbody", "tfoot"), (_ROW, _GROUP)))
#: Weight of a tag that is as common inside as outside, and the weight of one unit of log odds.
LEAST, UNIT = -0.1, 8.0


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """("text", text, False), ("open", name, is left out by its attributes) and ("close", name, False), in order.

    Comments, declarations and the insides of raw-text elements give nothing; what is not closed ends with the page.
    """
    at, end = 0, len(page)
    lower = None
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], False
            return
        if lt > at:
            yield "text", page[at:lt], False
        nxt = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
        elif nxt in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
        elif (m := NAME.match(page, lt + (2 if nxt == "/" else 1))) is None:
            if nxt == "/":
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:
                yield "text", "<", False
                at = lt + 1
        else:
            name, stop = m[0].lower(), _tag_end(page, m.end())
            if nxt == "/":
                yield "close", name, False
            else:
                inside = page[m.end():stop]
                hinted = any(HINT.search(x[0] or x[1] or x[2]) for x in ATTRIBUTE.findall(inside)) if "=" in inside else False
                yield "open", name, hinted
                if name in RAW:
                    lower = lower if lower is not None else page.lower() if page.isascii() else "".join(c.lower() if c.isascii() else c for c in page)
                    close = lower.find(f"</{name}", stop)
                    stop = end if close < 0 else close - 1
            at = stop + 1


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, quotes minded; the end of the page if there is none."""
    while True:
        gt = page.find(">", at)
        if gt < 0:
            return len(page)
        quote = re.compile("=\\s*([\"'])").search(page, at, gt)
        if quote is None:
            return gt
        close = page.find(quote[1], quote.end())
        if close < 0:
            return gt
        at = close + 1


class _Open:
    """Elements that are open, outermost first, with the ends that HTML lets a page omit. Void elements are never among them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter = Counter()

    def cut(self, size: int) -> None:
        while len(self.names) > size:
            self.count[self.names.pop()] -= 1

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def _end(self, ended, stops) -> None:
        """End the innermost element of ``ended`` that no element of ``stops`` shields."""
        if any(self.count[x] for x in ended):
            for at in range(len(self.names) - 1, -1, -1):
                if self.names[at] in ended:
                    return self.cut(at)
                if self.names[at] in stops:
                    return None

    def opening(self, name: str) -> None:
        """End what the start tag ``name`` ends."""
        if name in ENDS_P:
            self._end(("p",), SCOPE)
        for ended, stops in ENDS.get(name, ()):
            self._end(ended, stops)

    def closing(self, name: str) -> None:
        """End the element ``name`` and all inside it; an end tag without its element ends nothing."""
        self._end((name,), TABLE if name in ROWS else SCOPE)


def parts(page: str) -> list[tuple[str, str, int]]:
    """(kind, name or text, words): kind is "text", or "tag" with the name ("/name" for an end); left-out elements are gone.

    A left-out element ends with its own end tag, with a tag that ends it in HTML, or with an element around it. On a
    page without ``article`` and ``main``, one that only a hint marks stays if it holds most of the page's words.
    """
    items = []
    for kind, value, hinted in tokens(page):
        text = html.unescape(value) if kind == "text" else value
        items.append((kind, text, hinted and value not in ("html", "body", *ARTICLE) and value not in VOID and value not in LEFT_OUT, hinted, len(text.split()) if kind == "text" else 0))
    stay = frozenset()
    if any(x[2] for x in items) and not any(kind == "open" and value in ARTICLE and not hinted for kind, value, _, hinted, _ in items):
        stay = _wrappers(items)
    out: list[tuple[str, str, int]] = []
    gone, mark, stack = "", 0, _Open()
    for i, (kind, value, by_hint, hinted, words) in enumerate(items):
        if kind == "text":
            if not gone:
                out.append((kind, value, words))
            continue
        if gone:
            if kind == "open" and value in ARTICLE and not hinted and gone not in ARTICLE:  # an element that was never closed
                gone = ""
                stack.cut(mark)
            else:
                (stack.opening if kind == "open" else stack.closing)(value)
                if len(stack.names) > mark:
                    if kind == "open" and value not in VOID and (value not in INLINE or value == gone):
                        stack.push(value)
                    continue
                out.append(("tag", "-" + gone, 0))
                own, gone = kind == "close" and value == gone, ""
                if own:
                    continue
        elif kind == "close":
            stack.closing(value)
        if kind == "open":
            stack.opening(value)
            if value in LEFT_OUT or by_hint and i not in stay:
                gone, mark = value, len(stack.names)
                stack.push(value)
                out.append(("tag", "-" + value, 0))
                continue
            if value not in VOID and value not in INLINE:
                stack.push(value)
        out.append(("tag", value if kind == "open" else "/" + value, 0))
    return out


def _wrappers(items: list[tuple[str, str, bool, bool, int]]) -> frozenset[int]:
    """Items that open an element marked by a hint alone with over half of the words outside left-out elements."""
    stack, total, mark = _Open(), 0, None
    begun: list[tuple[int, int, int]] = []  # (place in the stack, item, words before)
    held: list[tuple[int, int]] = []
    for i, (kind, value, by_hint, _, words) in enumerate(items):
        if kind == "text":
            total += words if mark is None else 0
            continue
        (stack.opening if kind == "open" else stack.closing)(value)
        if mark is not None and len(stack.names) <= mark:
            mark = None
        while begun and begun[-1][0] >= len(stack.names):
            _, at, before = begun.pop()
            held.append((at, total - before))
        if kind == "open" and value not in VOID and (value not in INLINE or by_hint or stack.count[value]):
            if by_hint:
                begun.append((len(stack.names), i, total))
            if value in LEFT_OUT and mark is None:
                mark = len(stack.names)
            stack.push(value)
    held += [(at, total - before) for _, at, before in begun]
    return frozenset(at for at, words in held if 2 * words > total)


def labelled(pieces: list[tuple[str, str, int]]) -> tuple[Counter, Counter] | None:
    """Tags inside and outside the one article of a page; None for a page without just one."""
    for name in ARTICLE:
        first = [i for i, p in enumerate(pieces) if p[:2] == ("tag", name)]
        if len(first) == 1:
            last = next((i for i in range(len(pieces) - 1, -1, -1) if pieces[i][:2] == ("tag", "/" + name)), None)
            if last is not None:
                tags = [(i, p[1]) for i, p in enumerate(pieces) if p[0] == "tag"]
                return Counter(t for i, t in tags if first[0] < i < last), Counter(t for i, t in tags if not first[0] < i < last)
    return None


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best region, blocks joined by one space; empty when no region scores above zero."""
    pieces = parts(page)
    best, best_range, total, start = 0.0, None, 0.0, 0
    for i, (kind, value, words) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += words if kind == "text" else weights.get(value, LEAST)
        if total > best:
            best, best_range = total, (start, i + 1)
    if best_range is None:
        return ""
    out = []
    for kind, value, _ in pieces[best_range[0]:best_range[1]]:
        if kind == "text":
            out.append(value)
        elif value.lstrip("-/") not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def tag_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each tag from all labelled pages. Names that HTML does not know count as one, so the result is bounded."""
    known = set("html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption hr br img center address details summary "
                "fieldset legend caption picture source video audio input link meta".split()) | INLINE | LEFT_OUT | VOID

    def run(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                if (found := labelled(parts(page.as_py() or ""))) is not None:
                    inside += found[0]
                    outside += found[1]
        tags = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays([pa.array([t if t.lstrip("-/") in known else "?" for t in tags], pa.string()), pa.array([inside[t] for t in tags], pa.int64()),
                                          pa.array([outside[t] for t in tags], pa.int64())], ["tag", "inside", "outside"])

    counted = common.lean(pages).select(F.col(html_col).alias("html")).mapInArrow(run, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside"), F.sum("outside")).collect()
    return {t: min(LEAST, UNIT * math.log((i + 1) / (o + 1))) for t, i, o in counted}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null or empty page, and one without article text, gives an empty text. Repeated rows and null ids are treated
    like any other row; other columns are not read. Without labelled pages every tag has the least weight.
    """
    weights = tag_weights(pages, html_col)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py() or "", weights) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
