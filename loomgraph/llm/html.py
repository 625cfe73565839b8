"""Main text of web pages by consensus paths of each host."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, settle, small

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ID = re.compile(r"""\b(?:id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[a-z]+", re.I)

# Tag names of HTML and MathML by role, and names that pages give to what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded mphantom mfenced menclose mmultiscripts mtable mtr mtd semantics".split())
CONTAINERS = frozenset("body main article section div td center".split())
APART = frozenset("nav header footer aside noscript menu dialog fieldset head".split())
#: Elements without text of the article; those that swallow the rest of a page where their end is missing come first.
SWALLOW = frozenset("script style textarea title".split())
RAW = SWALLOW | frozenset("noscript template svg iframe object select button canvas audio video annotation".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar side aside nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer bottom related recommended recommendations share sharing social newsletter subscribe subscription signup login form search widget widgets toolbar pagination pager tags".split())
READERS = frozenset("comment comments commentlist commentary disqus reply replies respond discussion discussions guestbook".split())
#: Names that say advert or service wherever in a name they stand.
ADVERTS = frozenset("ads advert adverts advertisement advertising adsbygoogle adsense sponsored".split())
#: What stands before such a name, or after it, without making it another thing; a name of other words (binary-search) may well be
#: an article's own, and is judged by what it holds.
PLACES = frozenset("site page main top left right bottom upper lower global primary secondary post article blog entry content text body box bar block wrapper wrap container inner outer area section div form list item items link links widget module panel region group row col column fixed sticky mobile desktop user social google fb facebook twitter email mail sub the".split())
FIRST_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice sidebar nav navbar menu comment comments disqus share sharing social related newsletter".split())
#: Elements that are text whatever their class is called.
TEXTUAL = frozenset("body html article main blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 dl dt dd".split())

#: A named container that holds this share of a page's text is no sidebar of it, unless it is its readers'.
MAJORITY = 0.5
#: What a container beside the article must hold to count as part of it: characters of a block with an end of a sentence,
#: and where a host has few pages to vote, a share of the article's text.
PROSE, SHARE, FEW = 60, 0.05, 3
ENDED = re.compile(r"[.!?\u2026\u3002]")
#: Characters of a container within the article whose repetition on most pages of a host tells that it is none of it.
REPEATED = 24


def names_of(rest: str) -> tuple[list[str], str]:
    """The class names of a tag, and what its classes, id or role say: "" for nothing, "layout" or "readers" for no part of an article,
    "perhaps" for a layout's name among other words."""
    if "=" not in rest:
        return [], ""
    got = CLASS.search(rest)
    classes = (got[1] or got[2] or got[3] or "").split() if got else []
    perhaps = ""
    other = ID.search(rest)
    for name in [*classes, (other[1] or other[2] or other[3] or "") if other else ""]:
        words = [p.lower() for p in PIECE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        # has-sidebar and content-with-menu name the layout around an article.
        if words and not {"has", "with", "no"} & set(words):
            if words[-1] in READERS or words[0] in READERS & FIRST_NAMES:
                return classes, "readers"
            if ADVERTS & set(words) or words in (["site", "info"], ["colophon"]):
                return classes, "layout"
            if words[-1] in NAMES or words[0] in FIRST_NAMES:
                if words[0] in FIRST_NAMES or set(words) <= NAMES | PLACES:
                    return classes, "layout"
                perhaps = "perhaps"
    return classes, perhaps


def step_of(tag: str, classes: list[str]) -> str:
    """A path's step: tag and sorted classes, numbers generalised, so that post-17 and post-18 agree."""
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", c.lower()).replace("/", "|") for c in classes})])


def key_of(path: str) -> int:
    """A path as a number: each step is hashed with its parent's number, so a page's depth costs nothing."""
    key = 0
    for step in path.strip("/").split("/"):
        key = xxhash.xxh64_intdigest(step, key) if step else key
    return key


def signed(key: int) -> int:
    return key - (key >> 63 << 64)


class Page:
    """A page's containers, in order of their start, and its blocks (text, container, characters within links).

    Containers know their parent by number; whatever is summed along paths goes once through the containers, so time and
    memory grow with the page's length alone, however deep it is.
    """

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.step, self.key = [-1], ["body"], [""], [0]
        #: Of each container the nearest named one (or -1) that it is or lies in; of each named one what its name says.
        self.named, self.says = [-1], {}
        self.blocks: list[tuple[str, int, int]] = []
        self._read(html)
        self._settle_names()

    def _open(self, above: int, tag: str, classes: list[str], says: str) -> int:
        n = len(self.parent)
        step = step_of(tag, classes)
        self.parent.append(above)
        self.tag.append(tag)
        self.step.append(step)
        self.key.append(xxhash.xxh64_intdigest(step, self.key[above]))
        self.named.append(n if says else self.named[above])
        if says:
            self.says[n] = says
        return n

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # tag, container, set apart by a tag
        opened: Counter[str] = Counter()
        text: list[str] = []
        linked, in_link, at, never = 0, False, 0, set()
        lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]+", lambda m: m[0].lower(), html)

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join("".join(text).split())
                if whole and not stack[-1][2]:
                    self.blocks.append((whole, stack[-1][1], linked))
                text.clear()
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = unescape(piece)
                text.append(piece)
                if in_link:
                    linked += len(piece.strip())

        while m := TOKEN.search(html, at):
            add(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"]:
                    text.append(m["cdata"])  # as it stands: references mean nothing there
                continue
            tag, closed = tag.lower(), m["rest"].endswith("/")
            if tag in RAW:
                if not m["end"] and not (closed and tag not in SWALLOW) and tag not in never:
                    stop = lower.find(f"</{tag}", at)
                    if stop >= 0:
                        at = (html.find(">", stop) + 1) or len(html)
                    elif tag in SWALLOW:
                        at = len(html)
                    else:
                        never.add(tag)  # its end is nowhere: only the tag goes
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not m["end"]
                continue
            flush()
            if tag in VOID:
                continue
            if m["end"]:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        opened[stack.pop()[0]] -= 1
                    opened[stack.pop()[0]] -= 1
                    in_link = False
                continue
            # A block ends an open paragraph; a list item, a cell or a row ends its like.
            if len(stack) > 1 and (stack[-1][0] == "p" or (tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag)):
                opened[stack.pop()[0]] -= 1
                in_link = False
            if closed and tag not in CONTAINERS:
                continue
            classes, says = names_of(m["rest"])
            # A form may be a search box, or hold the whole page.
            says = "" if tag in TEXTUAL else says or ("layout" if tag == "form" else "")
            _, above, apart = stack[-1]
            stack.append((tag, self._open(above, tag, classes, says) if tag in CONTAINERS or says else above, apart or tag in APART))
            opened[tag] += 1
        add(html[at:])
        flush()

    def _settle_names(self) -> None:
        """Leave out blocks in named containers, but for those that hold most of the page's text; those that are only perhaps no part
        of the article stay if they hold prose of their own."""
        if not self.says:
            return
        total, held, prose = 0, Counter(), set()
        for text, node, linked in self.blocks:
            total += len(text)
            held[self.named[node]] += len(text)
            if len(text) >= PROSE and 3 * linked <= len(text) and ENDED.search(text):
                prose.add(self.named[node])
        gone = set()
        for n in sorted(self.says, reverse=True):  # inner ones first
            if self.says[n] == "perhaps" and n in prose:
                held[self.named[self.parent[n]]] += held[n]
            elif self.says[n] == "readers" or held[n] < MAJORITY * total:
                gone.add(n)
            else:
                held[self.named[self.parent[n]]] += held[n]
        for n in sorted(self.says):  # outer ones first: what lies in one that goes, goes
            if self.named[self.parent[n]] in gone:
                gone.add(n)
        self.blocks = [b for b in self.blocks if self.named[b[1]] not in gone]

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return "/" + "/".join(reversed(steps))

    def within(self, key: int) -> list[bool]:
        """Of each container whether it, or one around it, has the path ``key``."""
        inside: list[bool] = []
        for k, p in zip(self.key, self.parent, strict=True):
            inside.append(k == key or (p >= 0 and inside[p]))
        return inside

    def own(self) -> dict[int, list[tuple[str, int]]]:
        """Blocks that lie in a container itself, by container."""
        found = defaultdict(list)
        for text, node, linked in self.blocks:
            found[node].append((text, linked))
        return found


def blocks_of(html: str) -> Page:
    """The page's blocks outside what is set apart."""
    return Page(html)


def best_path(page: Page) -> tuple[str, float]:
    """The path of the container with the highest score: prose in its own blocks, less what is linked, and less what lies deeper."""
    raw = [0.0] * len(page.parent)
    for text, node, linked in page.blocks:
        raw[node] += (len(text) - 1.5 * linked) * (1.0 + 0.5 * min(1.0, 20 * sum(map(text.count, ".,;")) / max(1, len(text))))
    scores: dict[int, float] = defaultdict(float)
    first: dict[int, int] = {}
    # An article or main element says what it is; a nearer container gets more of a block's worth than one above.
    for n in range(len(raw) - 1, -1, -1):
        if raw[n]:
            scores[page.key[n]] += raw[n] * (1.5 if page.tag[n] in ("article", "main") else 1.0)
            first[page.key[n]] = n
            if page.parent[n] >= 0:
                raw[page.parent[n]] += 0.6 * raw[n]
    if not page.blocks or not scores:
        return "", 0.0
    best = max(scores, key=lambda k: (scores[k], k))
    return page.path(first[best]), scores[best]


def text_at(page: Page, path: str, more: frozenset[int] = frozenset(), less: frozenset[int] = frozenset()) -> str:
    """The text within ``path`` and in the containers at the paths ``more``, but for repeated containers (``less``)."""
    inside = page.within(key_of(path))
    gone = {n for n, parts in page.own().items() if page.tag[n] != "td" and mark_of(page, n, parts) in less} if less else set()
    return " ".join(text for text, node, _ in page.blocks if (inside[node] or signed(page.key[node]) in more) and node not in gone)


def whole_path(page: Page, path: str) -> str:
    """The path from which the whole article is read: ``path``, or one above it.

    That is the nearest article or main element above, else the nearest container but body that has blocks of its own, if
    what it adds isn't mostly links.
    """
    key = key_of(path)
    size, linked = [0] * len(page.parent), [0] * len(page.parent)
    direct = set()
    for text, node, n in page.blocks:
        size[node] += len(text)
        linked[node] += n
        direct.add(page.key[node])
    for n in range(len(size) - 1, 0, -1):
        size[page.parent[n]] += size[n]
        linked[page.parent[n]] += linked[n]
    own = next((n for n, k in enumerate(page.key) if k == key and size[n]), None)
    if own is None or page.tag[own] == "article":
        return path
    sizes, links = Counter(), Counter()
    for k, a, b in zip(page.key, size, linked, strict=True):
        sizes[k] += a
        links[k] += b
    named, others, n = [], [], page.parent[own]
    while n > 0:
        (named if page.tag[n] in ("article", "main") else others if page.tag[n] != "body" else []).append(n)
        n = page.parent[n]
    for n in [*named, *([] if page.tag[own] == "main" else others)]:
        k = page.key[n]
        text, linked_ = sizes[k] - sizes[key], links[k] - links[key]
        if text and 2 * linked_ <= text and (n in named or k in direct):
            return page.path(n)
    return path


def mark_of(page: Page, node: int, parts: list[tuple[str, int]]) -> int:
    """A number for a container's path and its own text together."""
    return signed(xxhash.xxh64_intdigest("\n".join(t for t, _ in parts), page.key[node]))


def votes_of(page: Page) -> list[tuple[str, str, int, float]]:
    """A page's votes (role, path, mark, worth).

    One goes to the path of its best container, with a mark of the article's text: pages that agree in it are one page to the
    other votes. Where that lies in no article or main element, containers beside it
    with prose of their own each have one ("beside"; worth says whether they hold a good share). Containers within the article
    that repeat on other pages word by word are found by theirs ("within", by mark alone).
    """
    path, score = best_path(page)
    if not path:
        return []
    root = whole_path(page, path)
    votes = [("best", path, signed(xxhash.xxh64_intdigest(text_at(page, root))), score)]
    inside, marked = page.within(key_of(root)), any(step.partition(".")[0] in ("article", "main") for step in root.split("/"))
    own = page.own()
    total = sum(len(t) for n, parts in own.items() if inside[n] for t, _ in parts)
    for n, parts in own.items():
        size, linked = sum(len(t) for t, _ in parts), sum(k for _, k in parts)
        if inside[n]:
            if page.key[n] != key_of(root) and page.tag[n] in ("div", "section") and size >= REPEATED:
                votes.append(("within", "", mark_of(page, n, parts), 0.0))
        elif not marked and 3 * linked <= size and any(len(t) >= PROSE and ENDED.search(t) for t, _ in parts):
            votes.append(("beside", page.path(n), mark_of(page, n, parts), float(size >= SHARE * total)))
    return votes


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def consensus_paths(pages: DataFrame) -> DataFrame:
    """``host, path, more, less``: what a host's pages agree on.

    ``path`` wins most pages as the best container, of such the one with the higher score. ``more`` are paths (numbers) beside
    it that hold prose on most pages, other prose on each; where there are fewer than FEW pages, a good share of them. ``less``
    are marks of containers within the article that are the same, word by word, on FEW pages or more and on most. Copies of
    a page are one page in these two. Votes are added up by all that tells them apart before a host's votes meet, so a hot host's
    are dealt out; what is gathered in the end has votes from half the pages, so it is no more than twice what a page holds.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            out = {"host": [], "role": [], "path": [], "mark": [], "key": [], "page": [], "worth": []}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                votes = votes_of(blocks_of(html or ""))
                for role, path, mark, worth in dict.fromkeys(votes):
                    row = (host, role, path if role == "best" else "", mark, signed(key_of(path)) if path else 0, votes[0][2], worth)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            return out

        return apply

    votes = over_batches(pages.select("_host", "html"), "host string, role string, path string, mark bigint, key bigint, page bigint, worth double", "html", make)
    each = settle(votes.groupBy("host", "role", "path", "key", "mark", "page").agg(F.count("*").alias("n"), F.sum(F.round("worth")).alias("worth"), F.max("worth").alias("strong")))
    wins = each.filter("role = 'best'").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("worth").alias("worth"), F.countDistinct("page").alias("pages"))
    best = wins.groupBy("host").agg(F.max(F.struct("n", "worth", "path")).alias("best"), F.sum("pages").alias("pages"))
    pages_of = best.select("host", "pages")
    beside = each.filter("role = 'beside'").groupBy("host", "key", "mark").agg(F.countDistinct("page").alias("n"), F.sum("strong").alias("strong"))
    beside = beside.groupBy("host", "key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("strong").alias("strong")).join(pages_of, "host")
    prose = F.when(F.col("pages") >= FEW, 2 * F.col("most") < F.col("n")).otherwise(F.col("strong") >= F.col("n"))
    more = beside.filter((2 * F.col("n") >= F.col("pages")) & prose).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("more"))
    within = each.filter("role = 'within'").groupBy("host", "mark").agg(F.countDistinct("page").alias("n")).join(pages_of, "host")
    less = within.filter((F.col("n") >= FEW) & (2 * F.col("n") >= F.col("pages"))).groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("less"))
    return best.select("host", F.col("best.path").alias("path")).join(more, "host", "left").join(less, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, path`` for each row of ``pages`` (page_id, url, html).

    A page that lacks its host's winning path, or has nothing there, is read at its own best container. From
    either, each page is read from the article around it (``whole_path``), with the containers beside it and without
    those within it that its host's pages agree on. Null or empty html, and pages without text, give an empty text. A null url
    has a host of its own, the empty one. Repeated rows are read one by one; they vote each. Pages may be of any length and depth.
    """
    hosted = pages.select("page_id", "url", "html").withColumn("_host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    winners = settle(consensus_paths(hosted))
    joined = hosted.join(small(winners.withColumnRenamed("host", "_host")), "_host", "left")

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            texts, used = [], []
            for html, path, more, less in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                page = blocks_of(html or "")
                if not (path and text_at(page, path)):
                    path = best_path(page)[0]
                path = whole_path(page, path)
                texts.append(text_at(page, path, frozenset(more or ()), frozenset(less or ())) if path else "")
                used.append(path)
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "path": used}

        return apply

    kind = pages.schema["page_id"].dataType.simpleString()
    return over_batches(joined.select("page_id", "url", "html", "path", "more", "less"), f"page_id {kind}, url string, text string, n_chars bigint, path string", "html", make)
