"""HTML extraction by consensus host paths.

Each page is read as a run of tags and texts. Containers (div, article, section and so on) are named by generalised
paths, tags with their classes with digits taken out, told apart by 64-bit hashes. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are known by tag or by whole class words, in inline elements too, and never count, however much text they hold.
Only where no plain text but headings stands outside of containers known by class does the largest of them stay (the same holds within it), and
its text counts a quarter in the scores. Words that also name parts of an article (`MILD`: social, legal, alert and the like) say nothing about
headings and paragraphs, nor about what stands in an `article` or `main`. A page's containers are scored by the text under them, more
for those that mark an article, less for text in links; each page shares out its vote among its containers by score. Votes are
added up by host and path in Spark, and every page is read once more with its host's winning path; headings and plain paragraphs that stand
before the chosen container in its parent (title, lead) join it. A page where that
path has less than a quarter of the score of the page's own best container is read with its own best.

Votes are aggregated partially, so one host may hold any share of the pages; winners (a row for each host) are broadcast only if
counted to be few, else joined. A page is gone through in a time in proportion to its length, whatever it nests or leaves open.

Defined cases: null or empty html, or html without text, gives an empty text; a null url or one without a host votes in one group;
repeated rows each get their text; unclosed and misnested tags close with their container; a tag ends at the next > outside of quotes, and from
the first quote on that is never closed at the next > of any kind; < that opens no tag is text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import checked_broadcast, spark_tables, stash
from rillstack.llm.url_filter import host

#: Hosts up to which the winning paths are broadcast.
BROADCAST_HOSTS = 200_000
#: Share of the own best container's score that the host's path must have on a page.
LEAST_SHARE = 0.25
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"[\s\x00]+")
#: Fixed values.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "noembed", "noframes"}
_CONTAINER = {"html", "head", "body", "div", "main", "section", "article", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "td", "th", "figure", "blockquote", "center", "fieldset", "details", "dialog", "menu", "button", "select", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "figcaption", "caption", "address", "summary"}
_BLOCK_ONLY = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "figcaption", "caption", "tr", "td", "th", "tbody", "thead", "address", "summary"}
_BREAK = {"hr"}
_NEVER = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog"}
_INLINE = {"span", "a", "ins", "b", "i", "em", "strong", "small", "label", "font", "mark", "u", "s", "sub", "sup", "big", "abbr", "cite", "q"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Class words are split at hyphens: one is bad if all its parts are bad or say where it stands, and not all the latter.
_BAD = re.compile(r"(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|notices?|alerts?|gdpr|popups?|modals?|sidebars?|side|widgets?|menus?|nav(?:bar|igation)?|breadcrumbs?|headers?|masthead|footers?|comments?|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommended|newsletters?|subscribe|subscription|signup|login|search|toolbar|pagination|pager|hidden|copyright|legal)\d*", re.I)
#: Of these, what may as well name a part of an article.
_MILD = re.compile(r"(?:social|legal|alerts?|notices?|copyright|search|headers?|side)\d*", re.I)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PLACE = re.compile(r"(?:page|site|main|global|top|bottom|left|right|center|inner|outer|upper|lower|primary|secondary|first|last|sub|small|large|mini|box|area|container|wrapper|wrap|list|bar|block|section|panel|items?|links?|group|row|col|columns?|entry|posts?|articles?|content|text|body|title|icons?|buttons?|btn|form|fields?|image|img|media|native|sticky|fixed|floating|mobile|desktop|js|module|region|zone|slot|unit|holder|layer|overlay|policy|law|info|message|success|warning|danger|error|user|blog)?\d*", re.I)
#: What a block counts for in a container that its class words speak against, but that holds most of the page's plain text.
_DOUBT = 0.25
_RAW_END = {tag: re.compile(rf"</{re.escape(tag)}\b", re.I) for tag in _RAW}
_EMPTY = re.compile(r"""(?:^|[\s"'])/\Z""")
_GOOD = re.compile(r"(?:^|[-_ ])(?:articles?|content|post|entry|story|body|text|main|page)(?:$|[-_ ]|\d)", re.I)


def bad(names: str, mild: bool = True) -> bool:
    """Whether a class or id word says that what it marks is not the page's own text; mild: words that may name a part of it count too."""
    for name in names.split():
        parts = re.split("[-_]+", name)
        speaks = [_BAD.fullmatch(x) and (mild or not _MILD.fullmatch(x)) for x in parts]
        if any(speaks) and all(x or _PLACE.fullmatch(y) or _MILD.fullmatch(y) for x, y in zip(speaks, parts, strict=True)):
            return True
    return False


def _tags(page: str):
    """(text before, closing, tag, attributes, where it ends) of each tag, and last the rest of the text."""
    at, begin, n, last, quotes = 0, 0, len(page), page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            jump = yield page[begin:at], "", "", "", 0
            at = begin = end + 3 if end >= 0 else n
            continue
        if at > last:  # no tag can end any more
            break
        m = _NAME.match(page, at + 1)
        if m is None:
            if page.startswith(("<!", "<?"), at):
                jump = yield page[begin:at], "", "", "", 0
                at = begin = page.find(">", at) + 1
            else:
                at += 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False
        end = rest.end() if rest else page.find(">", m.end()) + 1
        jump = yield page[begin:at], m[1], m[2].lower(), page[m.end() : end - 1], end
        at = begin = jump if jump is not None else end
        if jump is not None:
            yield None
    yield page[begin:], "", "", "", 0


class Page:
    """Blocks (container, text, characters in links, doubt, heading) of a page; containers as (parent, tag, classes, hash, depth),
    parents first. -1: none."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str, int, int, bool]] = []
        self.containers: list[tuple[int, str, tuple, int, int]] = []
        doubts: list[int] = []  # the doubtful container each stands in
        known: dict[tuple, int] = {}
        stack: list[tuple[str, int, bool, int, bool]] = []  # tag, container, never, doubt, inline
        text: list[str] = []
        link = linked = 0

        def close() -> None:
            nonlocal linked
            if text:
                whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if whole:
                    self.blocks.append((stack[-1][1] if stack else -1, whole, linked, stack[-1][3] if stack else -1, bool(stack) and stack[-1][0] in _HEADING))
                text.clear()
            linked = 0

        open_: Counter = Counter()  # tags on the stack

        def pop() -> str:
            tag = stack.pop()[0]
            open_[tag] -= 1
            return tag

        tags = _tags(page)
        for before, closing, tag, attributes, end in tags:
            if before and not (stack and stack[-1][2]):
                text.append(before)
                if link:
                    linked += len(before)
            if not tag:
                continue
            if closing:
                if tag == "a":
                    link = 0
                if open_[tag]:
                    if tag in _CONTAINER:
                        close()
                        while pop() != tag:
                            pass
                    elif stack[-1][4] and any(t == tag for t, *_, inline in self._inline(stack) if inline):
                        while pop() != tag:
                            pass
                continue
            if tag in _RAW:
                text.append(" ")
                if not _EMPTY.search(attributes):
                    found = _RAW_END[tag].search(page, end)
                    tags.send(page.find(">", found.end()) + 1 or len(page) if found else len(page))
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in _BREAK:
                close()
                continue
            if tag == "a":
                link = 1
            if tag in _VOID or not (tag in _CONTAINER or tag in _INLINE):
                continue
            marks = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(attributes)} if attributes else {}
            names = f"{marks.get('class', '')} {marks.get('id', '')}".strip()
            hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            if tag in _INLINE:
                if hidden or names and bad(names):
                    text.append(" ")
                    stack.append((tag, stack[-1][1] if stack else -1, True, stack[-1][3] if stack else -1, True))
                    open_[tag] += 1
                continue
            close()
            while stack and (stack[-1][4] or stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag):
                pop()
            parent, never, doubt = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (-1, False, -1)
            never = never or tag in _NEVER or hidden
            own_text = open_["article"] or open_["main"]
            if not never and names and tag not in ("html", "body", "article", "main") and bad(names, not (own_text or tag in _BLOCK_ONLY)):
                if tag in _BLOCK_ONLY:
                    never = True
                else:
                    doubts.append(doubt)
                    doubt = len(doubts) - 1
            number = parent
            if tag not in _BLOCK_ONLY:
                classes = tuple(sorted({re.sub(r"\d+", "", c) for c in marks.get("class", "").split()} - {""}))
                number = known.setdefault((parent, tag, classes), len(self.containers))
                if number == len(self.containers):
                    up, depth = (self.containers[parent][3], self.containers[parent][4]) if parent >= 0 else (0, 0)
                    name = hashlib.blake2b(f"{up} {tag}.{'.'.join(classes)}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    self.containers.append((parent, tag, classes, int.from_bytes(name, "big", signed=True), depth + 1))
            stack.append((tag, number, never, doubt, False))
            open_[tag] += 1
        close()
        # of doubtful containers only the largest stays, and only where no plain text but headings stands beside them; the same within it
        held, beside = [0] * len(doubts), [0] * (len(doubts) + 1)  # the last place: outside of all
        for b in self.blocks:
            if _plain(b):
                beside[b[3]] += 0 if b[4] else len(b[1])
                if b[3] >= 0:
                    held[b[3]] += len(b[1])
        for d in range(len(doubts) - 1, -1, -1):
            if doubts[d] >= 0:
                held[doubts[d]] += held[d]
        largest: dict[int, int] = {}
        for d, up in enumerate(doubts):
            if held[d] > held[largest[up]] if up in largest else held[d] > 0:
                largest[up] = d
        stays = [False] * len(doubts)
        for d, up in enumerate(doubts):  # those around come first
            stays[d] = (up < 0 or stays[up]) and not beside[up] and largest.get(up) == d
        self.blocks = [b for b in self.blocks if b[3] < 0 or stays[b[3]]]

    @staticmethod
    def _inline(stack: list) -> list:
        """The inline elements on top of the stack."""
        k = len(stack)
        while k and stack[k - 1][4]:
            k -= 1
        return stack[k:]

    def scores(self) -> list[float]:
        out = [0.0] * len(self.containers)
        for b in self.blocks:
            if b[0] >= 0 and _plain(b):
                out[b[0]] += len(b[1]) * (1.0 if b[3] < 0 else _DOUBT)
        for p in range(len(out) - 1, -1, -1):
            parent = self.containers[p][0]
            if parent >= 0:
                out[parent] += out[p]
        for p, (_, tag, classes, _, _) in enumerate(self.containers):
            out[p] *= {"article": 3.0, "main": 2.5, "html": 0.5, "body": 0.8}.get(tag, 2.0 if any(_GOOD.search(c) for c in classes) else 1.0)
        return out

    def under(self, own: int) -> list[str]:
        """The texts of the blocks in a container, after the plain ones that stand before it in its parent."""
        inside = [False] * len(self.containers)
        for p, (parent, *_) in enumerate(self.containers):
            inside[p] = p == own or parent >= 0 and inside[parent]
        parent, lead, out = self.containers[own][0], [], []
        for b in self.blocks:
            if b[0] >= 0 and inside[b[0]]:
                out.append(b[1])
            elif b[0] == parent and not out and _plain(b):
                lead.append(b[1])
        return lead + out if out else []


def _plain(block: tuple) -> bool:
    """Whether less than half of a block is in links."""
    return 2 * block[2] < len(block[1])


def vote(page: str) -> list[tuple[int, int, float]]:
    """(hash, depth, share of the page's vote) of each of its containers with a score."""
    own = Page(page)
    s = own.scores()
    total = sum(s)
    return [(c[3], c[4], x / total) for c, x in zip(own.containers, s, strict=True) if x > 0]


def extract(page: str, path: int | None = None) -> str:
    """The text under the container of the given path; under the page's own best if that has next to nothing."""
    own = Page(page)
    s = own.scores()
    best = max(range(len(s)), key=lambda p: (s[p], own.containers[p][4], -p), default=-1)
    host_ = next((p for p, c in enumerate(own.containers) if c[3] == path), -1)
    if host_ >= 0 and s[host_] > 0 and s[host_] >= LEAST_SHARE * s[best]:
        best = host_
    got = own.under(best) if best >= 0 else []
    return "\n".join(got or [b[1] for b in own.blocks])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path (its hash) with the most votes of each host (ties: the deeper, then the larger hash)."""

    def run(batches):
        for b in batches:
            rows = [(h, *v) for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for v in vote(page or "")]
            h, p, d, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.int64()), pa.array(d, pa.int64()), pa.array([round(x * 1_000_000) for x in s], pa.int64())], ["host", "path", "depth", "vote"])

    votes = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path long, depth long, vote long").groupBy("host", "path", "depth").agg(F.sum("vote").alias("vote"))
    return votes.groupBy("host").agg(F.max(F.struct("vote", "depth", "path")).alias("m")).select("host", F.col("m.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    winners = checked_broadcast(stash(host_paths(pages)), BROADCAST_HOSTS)
    rows = pages.select("page_id", "url", "html", host().alias("_h")).join(winners.select(F.col("host").alias("_h"), F.col("path").alias("_p")), "_h", "left")

    def run(batches):
        for b in batches:
            text = [extract(page or "", p) for page, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "_p").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark_tables(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extract": op7_html_extract}
ORACLES: dict[str, str] = {}
