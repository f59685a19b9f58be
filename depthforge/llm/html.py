"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  What its markup declares to be no text (scripts, styles, hidden parts)
or no article (navigation, adverts, comments and so on, by tag, role, class or id) is left out.  The first pass decides
blocks by their own figures: many links or a copyright sign are boilerplate, long blocks with many stop words are text.
Short blocks and blocks between the limits stay undecided, and the second pass gives them the label of the nearest
decided neighbours, headings looking ahead first.  A page of undecided blocks has its text where most of their words are.

``article`` elements that hold a good part of the words are the article, else ``main``: blocks outside are boilerplate,
and inside only links make blocks boilerplate, and short blocks between them, since articles have short paragraphs and
words of any language.  Without them the figures decide.

Markup may be broken: tags that are never closed hold their own text up to the next block, comments, scripts and tags
cut off run to the end of the page, an end tag closes what is open inside its element.

A null or empty page has an empty text.  Repeated rows are extracted one by one, also with null keys.  Very long pages
take time in proportion to their length.  Ties between neighbours keep the block.  An empty table gives an empty
result.  Only the key, the address and the page are read, so further columns can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthforge.llm.common import table

#: More characters in links than this share: boilerplate.
LINKS = 0.33
#: The same in an article: between both a block is undecided.
ARTICLE_LINKS = 0.8
#: Blocks shorter than this are undecided.
SHORT = 70
#: Blocks as long as this with STOPS or more stop words are text.
LONG = 200
STOPS = 0.30
#: Below this share of stop words a block outside an article is boilerplate, unless it is long and has no links.
FEW_STOPS = 0.15
#: A heading takes the label of text that begins within as many characters.
HEADING = 200
#: Short blocks alone are a page's text if they have more words.
FEW_WORDS = 3
#: The share of the words that makes such elements the article.
PART = 0.3

# Names of HTML elements and words.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content isn't text of the page.
SILENT = frozenset("audio canvas datalist head noscript object svg template video".split())
#: Elements that hold no article text.
ASIDE = frozenset("aside button dialog fieldset footer form menu nav search select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id of what is no article text.
MARKS = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification notifications pager pagination paywall popup promo promoted promotion promotions recommended related replies reply respond search share sharing "
    "sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: The same written together with other words.
JOINED = re.compile(
    r"ads?(?:area|banner|block|box|container|frame|slot|space|unit|wrap|wrapper|zone)|(?:.*)(?:breadcrumbs?|navbar|navigation|sidebar|toolbar)|(?:bottom|footer|main|side|site|sub|top)(?:menu|nav)"
    r"|comments?(?:area|body|box|form|list|section|thread|wrapper)|(?:reader|user)comments?|cookie(?:banner|bar|consent|notice)|footer(?:inner|links|wrap|wrapper)|(?:page|site)footer|share(?:bar|buttons?|links)|social(?:bar|links|media)"
)
#: Headings of what isn't the article, up to the next heading of their level.
ENDINGS = frozenset(
    "comment|comments|comments section|discussion|leave a comment|leave a reply|more stories|newsletter|reader comments|readers comments|related|related articles|related posts|related stories|replies|share this|subscribe|"
    "diskussion|kommentar schreiben|kommentare|leserkommentare|mehr zum thema|weitere artikel|articles liés|commentaires|laisser un commentaire|à lire aussi|artículos relacionados|comentarios|deja un comentario".split("|")
)
#: Words that mark a header, unless it is the article's.
HEADERS = frozenset("header head headerwrap pageheader siteheader topheader".split())
ARTICLE_MARKS = frozenset("article content entry main post story".split())

ENGLISH = (
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his if in into is it its more most no not of on one only or other our out over she so "
    "some such than that the their them then there these they this to up was we were what when which who will with would you"
)
GERMAN = (
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch "
    "nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur"
)
FRENCH = (
    "au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur leurs lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur "
    "tout un une vous"
)
SPANISH = (
    "al como con cuando de del desde donde el ella en entre era es esta este esto fue ha han hasta hay la las le les lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son "
    "su sus también un una uno y ya"
)
STOP_WORDS = frozenset(f"{ENGLISH} {GERMAN} {FRENCH} {SPANISH}".split())

COMMENT = r"<!--.*?(?:--!?>|\Z)"
ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
PIECE = re.compile(rf"{COMMENT}|<(/?)([a-zA-Z][^\s/>]*)(?:({ATTRIBUTES})(?:>|\Z)|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|itemprop|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNMARKED = re.compile(r"(?:has|no|non|with|without)[-_]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NAME = re.compile("[a-z0-9]+")
WORD = re.compile(r"[^\W\d_]+")
_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: int = 0  # its level
    inside: int = 0  # 2 in an article, 1 in what is main
    label: str = ""
    text: str = ""


@dataclass
class Element:
    name: str
    aside: bool = False  # no article text by its markup
    doubtful: bool = False  # unless the article is inside
    header: bool = False  # the page's, unless an article is around it
    article: int = 0
    end: int | None = None  # number of the piece that closes it


# ---------------------------------------------------------------- pieces


def pieces(page: str) -> list[tuple]:
    """("text", text), ("start", name, attributes) and ("end", name) in page order; comments and raw elements left out."""
    out, at, endless = [], 0, set()
    while m := PIECE.match(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                out.append(("text", m[0]))
        elif m[1]:
            out.append(("end", name))
        elif name in RAW:
            end = None if name in endless else _ends[name].search(page, at)
            if end:
                at = end.start()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
        else:
            out.append(("start", name, m[3] or ""))
    return out


def element(name: str, attributes: str) -> Element:
    """What a start tag declares."""
    own = Element(name, name in ASIDE or name in SILENT, name == "form", name == "header", {"article": 2, "main": 1}.get(name, 0))
    if not attributes:
        return own
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if name in ("html", "body"):
        return own
    if values.get("role") == "article" or values.get("itemprop") == "articlebody":
        own.article = 2
    elif values.get("role") == "main":
        own.article = 1
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", ""))
    marks = {w for c in f"{values.get('class', '')} {values.get('id', '')}".split() if not UNMARKED.match(c) for w in NAME.findall(c)}
    if not own.aside:
        own.aside = values.get("role") in ROLES
    if not own.aside and (hidden or marks & MARKS or any(map(JOINED.fullmatch, marks))):
        own.aside = own.doubtful = True
    own.header = own.header or bool(marks & HEADERS and not marks & ARTICLE_MARKS)
    if own.aside:
        own.article = 0
    return own


def tree(parts: list[tuple]) -> dict[int, Element]:
    """The block-level and marked elements by the number of their start tag, with their ends."""
    found, stack, count = {}, [], {}
    for i, p in enumerate(parts):
        if p[0] == "start" and p[1] not in VOID and not p[2].endswith("/"):
            own = element(p[1], p[2])
            if p[1] in BLOCKS or own.aside or own.article:
                found[i] = own
                stack.append(own)
                count[p[1]] = count.get(p[1], 0) + 1
        elif p[0] == "end" and count.get(p[1]):
            while True:
                own = stack.pop()
                count[own.name] -= 1
                if own.name == p[1]:
                    own.end = i
                    break
    return found


def declare(found: dict[int, Element], parts: list[tuple]) -> None:
    """A header is no article text outside articles; a doubtful element is the page's frame if an article is in it, or the first heading and most of the text."""
    starts, reach = [i for i, e in found.items() if e.article], -1
    firsts = [i for i, e in found.items() if e.name == "h1"]
    sizes = [0]
    for p in parts:
        sizes.append(sizes[-1] + (len(p[1]) if p[0] == "text" else 0))
    holds = lambda spots, i, end: (k := bisect_right(spots, i)) < len(spots) and spots[k] <= end
    for i, e in found.items():
        if e.article:
            reach = max(reach, len(parts) if e.end is None else e.end)
        if e.header and i > reach:
            e.aside, e.doubtful = True, e.name != "header"
        if e.aside and e.doubtful and e.end is not None:
            most = 2 * (sizes[e.end] - sizes[i]) > sizes[-1]
            e.aside = not (holds(starts, i, e.end) or most and holds(firsts, i, e.end))


def blocks(page: str | None) -> list[Block]:
    """The blocks with text that the markup doesn't leave out."""
    parts = pieces(page or "")
    found = tree(parts)
    declare(found, parts)
    anchors = [(i, p[0]) for i, p in enumerate(parts) if p[0] != "text" and p[1] == "a"]
    closed = {i for (i, kind), (_, after) in zip(anchors, anchors[1:], strict=False) if kind == "start" and after == "end"}
    out, now = [], Block()
    # ends of the elements around the current piece: those left out, and articles with the highest kind so far
    shut, around = [], []
    loose_aside = link = loose_link = False
    broken = 0  # parts of the block up to its last line break

    def flush(heading: int = 0):
        nonlocal now, broken
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now, broken = Block(heading=heading, inside=around[-1][1] if around else 0), 0

    for i, p in enumerate(parts):
        if p[0] == "text":
            if not shut and not loose_aside:
                text = unescape(p[1])
                now.parts.append(text)
                if link:
                    now.linked += len(" ".join(text.split()))
            continue
        name, own = p[1], found.get(i)
        while shut and shut[-1] <= i:
            shut.pop()
        if around and around[-1][0] <= i:
            flush()
            while around and around[-1][0] <= i:
                around.pop()
        if own is not None and own.article and not shut:
            flush()
            end = len(parts) if own.end is None else own.end
            around.append((min(end, around[-1][0]), max(own.article, around[-1][1])) if around else (end, own.article))
        if name in BLOCKS or own is not None:
            flush(int(name[1]) if p[0] == "start" and name in HEADINGS else 0)
            loose_aside, link = False, link and not loose_link
        if own is not None and own.aside:
            if own.end is None:
                loose_aside = True
            else:
                shut.append(min(own.end, shut[-1]) if shut else own.end)
        if name == "a":
            link, loose_link = p[0] == "start", i not in closed
        elif name == "br":
            if broken and not "".join(now.parts[broken:]).strip():
                flush()
            else:
                now.parts.append("\n")
                broken = len(now.parts)
    flush()
    return out


# ---------------------------------------------------------------- labels


def first_pass(b: Block, articles: bool) -> str:
    """good, bad, near or short; ``articles``: the block is in one."""
    n = len(b.text)
    share = b.linked / n
    if share > (ARTICLE_LINKS if articles else LINKS) or ("©" in b.text and not articles):
        return "bad"
    if n < SHORT:
        return "bad" if b.linked and not articles else "short"
    if articles:
        return "good" if share <= LINKS else "near"
    words = WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= STOPS and n >= LONG:
        return "good"
    other_script = sum(c >= "ɐ" for c in b.text) * 2 > n
    return "near" if other_script or stops >= FEW_STOPS or n >= LONG and not b.linked else "bad"


def _nearest(labels: list[str], border: str) -> list[tuple[str, int]]:
    """The last decided label before each block and its distance; ``border`` where there is none."""
    out, last, at = [], border, -1
    for i, x in enumerate(labels):
        out.append((last, i - at))
        if x in ("good", "bad"):
            last, at = x, i
    return out


def article(found: list[Block]) -> list[Block]:
    """The blocks of the article by its element; none if no such element holds a good part of the words."""
    size = lambda blocks_: sum(len(b.text.split()) for b in blocks_ if b.linked <= LINKS * len(b.text))
    for kind in (2, 1):
        own = [b for b in found if b.inside >= kind]
        if own and size(own) >= PART * size(found):
            return [b for b in found if b.inside >= kind or (b.inside and b.heading)]
    return []


def label(found: list[Block]) -> list[Block]:
    """``found`` with their labels, good or bad."""
    own = article(found)
    for b in found:
        b.label = "bad"
    articles, own = bool(own), own or found
    labels = ["bad" if gone else first_pass(b, articles) for b, gone in zip(own, endings(own), strict=True)]
    labels = labels if articles else headings(own, anchored(own, labels))
    border = "good" if articles else "bad"
    before, after = _nearest(labels, border), _nearest(labels[::-1], border)[::-1]
    for b, x, (p, dp), (q, dq) in zip(own, labels, before, after, strict=True):
        if x in ("near", "short"):
            closer = p if dp < dq else q if dq < dp else "good"
            x = p if p == q else "good" if articles or x == "near" else closer
        b.label = x
    return found


def endings(found: list[Block]) -> list[bool]:
    """Whether a block belongs to comments, related pages or the like by the heading above it."""
    out, level = [], 0
    for b in found:
        if b.heading and b.heading > 1 and " ".join(WORD.findall(b.text.lower())) in ENDINGS:
            level = b.heading
        elif b.heading and level and b.heading <= level:
            level = 0
        out.append(level > 0)
    return out


def anchored(found: list[Block], labels: list[str]) -> list[str]:
    """Where no block is text by itself: the undecided ones of the run between boilerplate that has the most words, those near text if there are any."""
    if "good" in labels:
        return labels
    for kind in ("near", "short"):
        runs, begun = [], 0
        for i, x in enumerate([*labels, "bad"]):
            if x == "bad":
                runs.append(range(begun, i))
                begun = i + 1
        size = lambda run, kind=kind: sum(len(found[i].text.split()) for i in run if labels[i] == kind)
        best = max(runs, key=size)
        if size(best) > (0 if kind == "near" else FEW_WORDS):
            return ["good" if i in best and x == kind else x for i, x in enumerate(labels)]
    return labels


def headings(found: list[Block], labels: list[str]) -> list[str]:
    """A short heading that text follows soon is near it."""
    out = list(labels)
    for i, b in enumerate(found):
        if b.heading and labels[i] == "short":
            gap, j = 0, i + 1
            while j < len(found) and gap <= HEADING:
                if labels[j] == "good":
                    out[i] = "near"
                    break
                gap += len(found[j].text)
                j += 1
    return out


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in label(blocks(page)) if b.label == "good")


# ---------------------------------------------------------------- operator


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", all_blocks: bool = False) -> DataFrame:
    """(key, url, text) per page; with ``all_blocks`` (key, url, blocks): each block's text, label, characters in links the level of a heading and whether it is in an article."""
    wanted = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("key", "url"))
    last = "blocks array<struct<text: string, label: string, linked: int, heading: int, inside: int>>" if all_blocks else "text string"
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("linked", pa.int32()), ("heading", pa.int32()), ("inside", pa.int32())])) if all_blocks else pa.string()

    def one(page: str | None):
        if not all_blocks:
            return main_text(page)
        return [{"text": b.text, "label": b.label, "linked": b.linked, "heading": b.heading, "inside": b.inside} for b in label(blocks(page))]

    def run(batches):
        for batch in batches:
            done = pa.array([one(x.as_py()) for x in batch.column("html")], kind)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), done], names=["key", "url", last.split()[0]])

    return wanted.mapInArrow(run, f"{kinds}, {last}")


def op12(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
