"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by the elements
around them, tags score negative; one linear scan finds the contiguous stretch
with the highest sum. Its blocks are the text, without words whose score is
negative by the classes and ids around them (an advert between two paragraphs, say)
or as items of a list of links; element names alone cut nothing out.

The weights come from labelled pages: pages that mark their content with one
``article`` or ``main`` element. Over a sample of ``LABELLED`` such pages (by the
smallest hash of the page id) the log-odds of standing inside are counted for
every element name and every word of a class or id, for words and for tags. The
words of all pages are scored by them; a mark is one more name, whose weight is
not bounded. Boxes (``div``, ``section``) weigh nothing, and list elements only
where the item is links alone: a list with text of its own is not a menu. Names
that always mean menus, notices, adverts, forms or comments are fixed; an
``article`` in them marks nothing. They are no veto on an element that holds most
of the marked words and is no list of links (a section named ``search`` about
searching), unless it is named after the comments of readers.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one line end. ``br`` is white space; elements that start a
line of their own separate blocks. Scripts, styles, comments of the markup and
the title never count; the tags of the head are read past, as they may be omitted. Defined results: null or empty html and pages without a
positive stretch give the empty text; unclosed and unknown elements are read as
far as they go; repeated rows are read each. Columns besides the three are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import map_batches, quoted

LABELLED = 2_000
LIMIT = 4.0  # bound of one learned weight
LEAST_TAG = -0.2  # every tag costs this much at least
# Furniture is never returned, so it need not keep what follows it out of the stretch.
FURNITURE_TEXT = -1.0
PLAIN_WORD = 1.0  # a word without any known name around it
MAIN = {"article", "main"}
# Fixed names. Elements whose content is no text at all:
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "title"}
# Of these, elements that hold plain characters and end at their own end tag only; others end with what is around them.
RAW = {"script", "style", "textarea"}
FOREIGN = {"svg", "math"}  # these end where an HTML block begins, unless in one of
HTML_INSIDE = {"foreignobject", "desc", "title", "annotation-xml", "template"}
# Elements and roles that are never the article:
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "datalist", "input", "label"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar", "button"}
# Words of a class or id that are never the article, alone or with each other and ``BOXES``. Other names that hold such a
# word (no-sidebar, comments-open) are judged as a whole by the learned weights.
FURNITURE_WORDS = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:s|ed)?|promo(?:s|tion)?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"footers?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|signup|login|shar(?:e|ing)|social|"
    r"related|recommended|comments?|disqus|replies|respond|widgets?|toolbar|pagination|pager|masthead|topbar|copyright|search)"
)
BOXES = set(
    "area article articles banner bar block bottom box boxes button buttons col column container content div entry form group header icons inner "
    "item items left link links list main mini outer page panel post posts primary right row secondary section site slot stories story text "
    "title top unit wrap wrapper".split()
)
# Names that hold a word of both are the comments of readers, whatever else they hold; so are the names of the third.
READERS = {"user", "users", "reader", "readers", "visitor", "visitors", "customer", "customers", "guest", "guests", "member", "members", "community"}
VOICES = {"comment", "comments", "feedback", "reply", "replies", "response", "responses", "reaction", "reactions", "opinion", "opinions", "discussion"}
COMMENTS = {".comment", ".comments", ".disqus", ".replies", ".respond"}
# Elements that say nothing of their content:
PLAIN_BOXES = {"div", "section", "span"}
LISTS = {"ul", "ol", "li"}
LINK_WORDS = 10  # a list of links has fewer words a link
# Elements that are the page or its content, whatever class they have.
WHOLE = MAIN | {"html", "body"}
HEADER = "header"  # furniture, unless it stands inside the marked content
# Elements that start a line of their own:
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements without content of their own; a head is where its elements are.
VOID = set("head area base br col embed hr img input link meta param source track wbr".split())
# Inline elements are kept open only from one that is furniture to its end or that of the block around it, so unclosed ones do little harm.
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var del".split())
IMPLIED_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Piece:
    """A stretch of text or a tag, with the names around it."""

    text: str | None  # None for a tag
    names: frozenset[str]
    tag: str
    inside: bool
    furniture: bool
    block: int
    link: bool = False


def _names(tag: str, attributes: str) -> tuple[set[str], bool, bool]:
    """Names of an element, whether they make it furniture, and whether only its class or id does."""
    names, furniture, called = {tag} - PLAIN_BOXES, tag in FURNITURE_TAGS, False
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "role":
                furniture |= value.strip().lower() in FURNITURE_ROLES
            elif key == "hidden":
                furniture = True
            elif key == "aria-hidden":
                furniture |= value.strip().lower() == "true"
            else:
                for name in value.split():
                    words = {w.lower() for w in NAME_WORD.findall(name)}
                    bad = {w for w in words if FURNITURE_WORDS.fullmatch(w)}
                    if words & READERS and words & VOICES and tag not in WHOLE:
                        names |= {f".{w}" for w in words} | {".comments"}
                        called = True
                    elif not bad or tag not in WHOLE and words <= bad | BOXES:
                        names |= {f".{w}" for w in words}
                        called |= bool(bad)
                    else:
                        names |= {f".{w}" for w in words - bad}
                        if words > bad:
                            names.add(f".{name.lower()}")
    return names, furniture or called, called and not furniture


def pieces(html: str) -> list[Piece]:
    """The words and tags of a page in order."""
    found, marks, named = _read(html, frozenset())
    wrappers: set[int] = set()
    if marks or named:  # content within elements that are furniture by their class or id
        ahead, marked = [0], 0
        for p in found:
            words = 0 if p.text is None else len(p.text.split())
            ahead.append(ahead[-1] + words)
            marked += words if p.inside else 0
        for place, begin, end in named:
            words, tags = ahead[end] - ahead[begin], sum(p.tag == "a" for p in found[begin:end])
            if 2 * words > marked and 2 * words >= LINK_WORDS * tags:  # a link has two tags
                wrappers.add(place)
        for tag, begin, end, around in marks:
            if tag == "main" or 2 * (ahead[end] - ahead[begin]) > ahead[-1]:
                wrappers.update(around)
    return _read(html, frozenset(wrappers))[0] if wrappers else found


def _tell_lists(out: list[Piece], tags: list[tuple[int, bool]]) -> None:
    """Take the list names off words and tags of list items that have text beside links.

    ``tags`` are the places of list tags and whether they are end tags. A start tag
    goes with the words behind it, an end tag with those before it.
    """
    places = [k for k, _ in tags] + [len(out)]
    plain: list[bool | None] = []
    for begin, end in zip(places[:-1], places[1:], strict=True):
        words = [p for p in out[begin + 1 : end] if p.text is not None and p.text.strip()]
        plain.append(any(not p.link for p in words) if words else None)
        if plain[-1]:
            for p in words:
                p.names -= LISTS
    before, behind = False, False
    for (k, is_end), own in zip(tags, [None, *plain], strict=False):
        before = before if own is None else own
        if is_end and before:
            out[k].tag += " of text"
    for (k, is_end), own in zip(reversed(tags), reversed(plain), strict=True):
        behind = behind if own is None else own
        if not is_end and behind:
            out[k].tag += " of text"


def _read(html: str, wrappers: frozenset[int]) -> tuple[list[Piece], list[tuple[str, int, int, list[int]]], list[tuple[int, int, int]]]:
    """The pieces of a page, marks in furniture, and such furniture in marks, by class or id alone.

    A mark is its element, its first piece, the one behind its last, and where that
    furniture begins; furniture in a mark is where it begins, its first piece and the
    one behind its last. Furniture that begins at one of ``wrappers`` is none.
    """
    out: list[Piece] = []
    opened: list[tuple[str, frozenset[str], bool, bool]] = []  # tag, names, inside, furniture
    nothing: tuple[str, frozenset[str], bool, bool] = ("", frozenset(), False, False)
    called: list[tuple[int, int]] = []  # depth and place of open elements that are furniture by class or id alone
    open_marks: list[tuple[int, str, int, list[int]]] = []  # depth, element, first piece, furniture around it
    marks: list[tuple[str, int, int, list[int]]] = []
    open_named: list[tuple[int, int, int]] = []  # depth, place and first piece
    named: list[tuple[int, int, int]] = []
    lists: list[tuple[int, bool]] = []
    link = False
    block, at, hidden = 0, 0, ""
    within: list[str] = []  # open elements in the hidden one

    def text(raw: str) -> None:
        if raw:
            _, names, inside, furniture = opened[-1] if opened else nothing
            out.append(Piece(unescape(raw), names, "", inside, furniture, block, link))

    def closed(depth: int) -> None:
        del opened[depth:]
        while called and called[-1][0] >= depth:
            called.pop()
        while open_marks and open_marks[-1][0] >= depth:
            _, tag, begin, around = open_marks.pop()
            marks.append((tag, begin, len(out), around))
        while open_named and open_named[-1][0] >= depth:
            _, place, begin = open_named.pop()
            named.append((place, begin, len(out)))

    for match in TOKEN.finditer(html):
        if hidden:
            tag = (match[3] or "").lower()
            if tag == hidden and match[2] and (hidden in RAW or hidden not in within):
                hidden, at = "", match.end()
                continue
            if hidden in RAW or not tag or within and within[-1] in RAW and not (match[2] and tag == within[-1]):
                continue
            if match[2]:
                if tag in within:
                    while within.pop() != tag:
                        pass
                    continue
                if tag != "head" and all(o[0] != tag for o in opened):
                    continue
            elif tag != "body" and not (hidden in FOREIGN and tag in BLOCKS and not HTML_INSIDE & set(within)):
                if tag not in VOID and not match[4].endswith("/"):
                    within.append(tag)
                continue
            hidden, at = "", match.start()  # unclosed: ends with what is around it
        text(html[at : match.start()])
        at = match.end()
        if match[1] is not None:
            out.append(Piece(match[1], *(opened[-1] if opened else nothing)[1:2], "", *(opened[-1] if opened else nothing)[2:], block))
            continue
        if match[3] is None:
            continue
        tag = match[3].lower()
        if not match[2] and tag in HIDDEN and not match[4].endswith("/"):
            hidden, within = tag, []
            continue
        if tag in BLOCKS:
            block += 1
            link = False
        elif tag == "a":
            link = not match[2]
        if match[2]:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == tag:
                    closed(k)
                    break
                if tag in INLINE and opened[k][0] not in INLINE:  # of another block
                    break
        else:
            if tag in IMPLIED_END:
                for k in range(len(opened) - 1, -1, -1):
                    if opened[k][0] == tag:
                        closed(k)
                        break
                    if opened[k][0] not in IMPLIED_END and opened[k][0] not in INLINE:
                        break
            kept = tag not in INLINE or bool(match[4]) and _names(tag, match[4])[1]
            kept |= bool(opened) and opened[-1][0] in INLINE  # within one that is open, to tell their end tags apart
            if tag not in VOID and kept and not match[4].endswith("/"):
                _, around, inside, furniture = opened[-1] if opened else nothing
                if tag == "p" and opened and opened[-1][0] in {f"h{k}" for k in range(1, 7)}:
                    closed(len(opened) - 1)
                    _, around, inside, furniture = opened[-1] if opened else nothing
                own, bad, by_name = _names(tag, match[4])
                if by_name and match.start() in wrappers:
                    own, bad = {n for n in own if not FURNITURE_WORDS.fullmatch(n[1:])}, False
                elif by_name:
                    called.append((len(opened), match.start()))
                    if inside and not own & COMMENTS:
                        open_named.append((len(opened), match.start(), len(out)))
                if tag in MAIN and called:
                    open_marks.append((len(opened), tag, len(out), [place for _, place in called]))
                if not inside:
                    bad |= tag == HEADER or f".{HEADER}" in own and tag not in MAIN
                opened.append((tag, around | own, inside or tag in MAIN and not (furniture or bad), furniture or bad))
        if tag == "br":
            text(" ")
        _, names, inside, furniture = opened[-1] if opened else nothing
        if tag in LISTS:
            lists.append((len(out), bool(match[2])))
        out.append(Piece(None, names, tag, inside, furniture, block))
    if not hidden:
        text(html[at:])
    closed(0)
    _tell_lists(out, lists)
    return out, marks, named


def _counts(html: str) -> Counter:
    """For a labelled page: how often each name stands around words, and each tag, inside and outside."""
    found: Counter = Counter()
    read = pieces(html)
    if not any(p.inside for p in read):  # the mark stands in furniture
        return found
    for p in read:
        if p.text is None:
            if p.tag not in PLAIN_BOXES:
                found["<" + p.tag, p.inside] += 1
        else:
            n = len(p.text.split())
            for name in p.names if n else ():
                found[name, p.inside] += n
    return found


def learn_weights(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights by name, and by ``<`` and name for tags, from ``page_id, html``."""
    marks = F.regexp_count("html", F.lit(r"(?i)<(article|main)[\s>]"))
    chosen = pages.where(marks == 1).select("page_id").where(F.col("page_id").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id").limit(labelled)
    sample = pages.join(F.broadcast(chosen.distinct()), "page_id", "left_semi").where(marks == 1).limit(labelled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column("html"):
                total.update(_counts(html.as_py()))
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            ["name", "inside", "n"],
        )

    counted = map_batches(sample.select("html"), work, "name string, inside boolean, n long")
    names = counted.groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("outside"))
    weights = {}
    for row in names.collect():  # the names of at most ``labelled`` pages
        odds = math.log(((row.inside or 0) + 1) / ((row.outside or 0) + 1))
        if row.name not in MAIN:
            odds = max(-LIMIT, min(LIMIT, odds))
        weights[row.name] = min(LEAST_TAG, odds) if row.name.startswith("<") else odds
    return weights


def main_text(html: str, weights: dict[str, float]) -> str:
    """The text of the best stretch of a page."""
    if not html:
        return ""
    found = pieces(html)
    best = total = 0.0
    start, span = 0, (0, 0)
    own: dict[frozenset[str], float] = {}
    cut = []
    for k, p in enumerate(found):
        if p.text is None:
            score = 0.0 if p.furniture else weights.get("<" + p.tag, LEAST_TAG)
        elif p.furniture:
            score = 0.0 if p.inside else FURNITURE_TEXT
        else:
            word = own.get(p.names)
            if word is None:
                word = own[p.names] = sum(weights.get(n, 0.0) for n in sorted(p.names)) + PLAIN_WORD
            score = word * len(p.text.split())
        cut.append(p.furniture or score <= 0 and (bool(p.names & LISTS) or sum(weights.get(n, 0.0) for n in p.names if n[0] == ".") < 0))
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    lines: list[str] = []
    block, text = -1, []
    for p, gone in zip(found[slice(*span)], cut[slice(*span)], strict=True):
        if p.text is None:
            continue
        if p.block != block:
            lines.append("".join(text))
            block, text = p.block, []
        if not gone or not p.text.strip() and not p.furniture:
            text.append(p.text)
    lines.append("".join(text))
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def extract(pages: DataFrame, labelled: int = LABELLED, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    plain = pages.select(
        F.col(quoted(id_column)).cast("long").alias("page_id"), F.col(quoted(url_column)).cast("string").alias("url"),
        F.coalesce(F.col(quoted(html_column)).cast("string"), F.lit("")).alias("html"),
    )
    weights = learn_weights(plain.select("page_id", "html"), labelled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), weights) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_batches(plain, work, "page_id long, url string, text string, n_chars long")
