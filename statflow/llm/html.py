"""Main text of web pages by consensus host paths.

1. Each page is parsed into blocks of text inside containers. A block counts
   for its container in full and for the container around it by half; text of
   links counts against. The page votes for the path of tags and generalised
   classes (digits become #) that leads to its best container.
2. Spark counts the votes per host. Winners are the path with most votes (ties
   go to the lesser one) and any other with at least MINOR votes and a quarter
   of the first one's, so a host may have several templates; at most MOST paths,
   as each has a share of one in MOST or more. Only (host, path, count) is
   shuffled, summed first.
3. Pages are read again with the winners of their host: by the page's own best
   path where that is a winner, else by the first winner that has text on the
   page, unless the page's best is an article element that holds more. A page
   with no winner is read by its own best container.

Boilerplate is known by its tag (nav, footer, aside, form, ...) or by a class, id
or role that is as a whole the name of an advert, menu, sidebar, notice, share
bar, newsletter box or comment list, with parts of layout around it at most
(ad-slot, site-footer); words inside longer names, and ids of headings, say
nothing. It is left out everywhere. Names that content may bear as well (header,
form, discussion, related, search, ...) count as boilerplate only outside of
articles and winning containers; inside, their container goes only if most of its
text is links.

Blocks are what block-level tags enclose; a line break ends one as well. References are
decoded, white space (as Unicode has it) becomes one space, blocks are joined by
a line feed.

Edge cases: a null or empty html gives an empty text, as does a page of
boilerplate alone; a null url belongs to no host: the page's own best container
counts; unclosed tags, comments and scripts end with the page; repeated rows are
treated one by one; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize
from statflow.plans.lookup import join_lookup

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select|object|button)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/a-zA-Z][^>]*+>|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
LONG_PATH = 500
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|object|button"
_OPEN = re.compile(rf"<!--|<(?:{_RAW})\b[^>]*+>", re.I)
_CLOSED = re.compile(rf"</(?:{_RAW})\s*+>\Z", re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CONTAINERS = frozenset("html body main article section div td th table tbody tr center blockquote header footer nav aside form fieldset figure dialog details menu dl ul ol".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr br figcaption summary caption option legend head thead tfoot".split())
_VOID = frozenset("img input meta link source track wbr area base col embed param".split())
_CANDIDATES = frozenset("body main article section div td center blockquote".split())
_JUNK_TAGS = frozenset("nav footer aside form dialog menu fieldset head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_AROUND = "box|slot|unit|container|wrapper|wrap|inner|outer|banner|bar|block|blocks|list|area|section|link|links|button|buttons|icon|icons|widget|item|items|top|bottom|left|right|mobile|desktop|main|primary|secondary|message|#"
#: Names that are boilerplate wherever they stand.
_JUNK = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|sticky|fixed|user|reader|post|article|entry|blog|inline|js|wp|google|gpt)-)*"
    r"(?:ad|ads|adbox|adslot|advert|adverts|advertisement|advertisements|advertising|adsense|adsbygoogle|sponsor|sponsors|sponsored|promo|promos|promotion|promotions|outbrain|taboola"
    r"|cookie|cookies|cookie-?(?:notice|consent|law|policy|message)|consent|gdpr|paywall|nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|skip|skip-?link|skip-to-content"
    r"|sidebar|side-bar|footer|masthead|notice|notices|comments?|comment-?list|comments?-(?:thread|form|count|title|body|text|content)|comment-respond|reader-comments|disqus|disqus-thread"
    r"|share|sharing|social|social-?(?:media|share|sharing)|newsletter|newsletter-(?:form|signup)|subscribe|subscribe-form|signup|sign-up|signup-form|popup|pop-up|modal|complementary|contentinfo|alertdialog)"
    rf"(?:-(?:{_AROUND}))*"
)
#: Names that content may bear too.
_SOFT = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|sticky|fixed|user|search|contact|login)-)*"
    r"(?:header|form|search|alert|alerts|banner|toolbar|tools|copyright|disclaimer|widget|widgets|overlay|hidden|discussion|feedback|reply|replies|respond|response|responses"
    r"|(?:related|recommended|more|popular|latest|trending)(?:-(?:posts?|articles?|stories|links|content|reading|news))?|recommendations|tags|meta|author-box|login)"
    rf"(?:-(?:{_AROUND}))*"
)
_ABOUT = re.compile(r"(?:^|[-_])(?:has|with|no|without)[-_]")  # says what an element holds or lacks, not what it is
_KEEP = frozenset(("article", "main"))
MINOR = 3
MOST = 20


def host(url: str) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _step(tag: str, attrs: str) -> tuple[str, int]:
    """Generalised step of a path; 2 for boilerplate, 1 for what may be, else 0."""
    level, names = 2 if tag in _JUNK_TAGS else tag == "header", ""
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role"):
                if tag not in ("html", "body", *_KEEP) and not (name == "id" and tag in _HEADINGS):
                    for x in value.split():
                        if not _ABOUT.search(x):
                            x = re.sub(r"\d+", "#", x.replace("_", "-"))
                            level = max(level, 2 if _JUNK.fullmatch(x) else 1 if _SOFT.fullmatch(x) else 0)
                if name == "class" and value.strip():
                    names = "." + ".".join(sorted(re.sub(r"\d+", "#", x) for x in value.split()))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                level = 2
    return tag + names, level


class Page:
    """Elements as (parent, path, is candidate, may be boilerplate, is inside an article), blocks as
    (element, text, link characters), sure boilerplate left out."""

    def __init__(self, source: str):
        self.parent, self.path, self.candidate, self.soft, self.kept = [-1], [""], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        parts: list[str] = []
        linked, link = 0, False
        skip, depth = "", 0  # an inline element that is boilerplate, and how often its tag is open
        at = 0

        def close() -> None:
            nonlocal linked
            if parts and not stack[-1][2]:
                text = " ".join(_html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
            parts.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if skip:
                return
            parts.append(text)
            if link:
                linked += len(text)

        # No tag ends after the last ">": text from there on is read as such, up to what an open comment or script hides.
        stop = source.rfind(">") + 1
        hidden = _OPEN.search(source, stop)
        tail = source[stop : hidden.start()] if hidden else source[stop:]
        for m in _TOKEN.finditer(source, 0, stop):
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if skip and tag == skip:
                depth += -1 if m[2] else 1
                skip = skip if depth else ""
            elif tag and not m[2] and m[4] and tag not in _CONTAINERS and tag not in _BLOCKS and tag not in _VOID and not skip and _step(tag, m[4])[1] == 2:
                skip, depth = tag, 1
            elif tag == "a":
                link = not m[2]
            elif tag in _CONTAINERS:
                close()
                skip = ""
                link = False
                if m[2]:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                elif not m[4].endswith("/"):
                    step, level = _step(tag, m[4])
                    if stack[-1][0] in _BLOCKS and stack[-1][0] not in ("head", "li", "dd"):
                        stack.pop()
                    _, up, bad = stack[-1]
                    self.parent.append(up)
                    path = self.path[up]
                    if len(path) > LONG_PATH:  # deep nesting: its digest stands for the outer part
                        path = "#" + md5(path.encode("utf-8", "replace")).hexdigest()
                    self.path.append(f"{path}>{step}" if path else step)
                    self.candidate.append(tag in _CANDIDATES)
                    self.soft.append(level == 1)
                    self.kept.append(self.kept[up] or tag in _KEEP)
                    stack.append((tag, len(self.parent) - 1, bad or level == 2))
            elif tag in _BLOCKS:
                close()
                if tag != "br":
                    link, skip = False, ""
                if not m[2] and tag != "br" and stack[-1][0] in _BLOCKS and stack[-1][0] != "head":
                    stack.pop()  # a block ends where the next begins
                if tag == "head":
                    if m[2]:
                        stack[:] = [s for s in stack if s[0] != "head"]
                    else:
                        stack.append(("head", stack[-1][1], True))
                elif not m[2] and m[4]:
                    # A block that is itself boilerplate: its text is dropped where it ends.
                    if _step(tag, m[4])[1] == 2 and tag not in ("br", "hr"):
                        stack.append((tag, stack[-1][1], True))
                elif m[2] and stack[-1][0] == tag:
                    stack.pop()
            if m[3] and tag == "body" and not m[2]:
                stack[:] = [s for s in stack if s[0] != "head"]
            if not m[3] and at == stop and not m[0].endswith("-->") and not (m[1] and _CLOSED.search(m[0])) and _OPEN.match(m[0]):
                tail = ""  # the last comment or script never ends
        add(source[at:stop] + tail)
        close()

    def best(self) -> int:
        """The best candidate element; 0, the whole page, where no text is in any."""
        score: dict[int, float] = {}
        out = [False] * len(self.parent)  # may be boilerplate, and no article is around it
        for e in range(1, len(self.parent)):
            out[e] = not self.kept[e] and (self.soft[e] or out[self.parent[e]])
        for element, text, linked in self.blocks:
            if out[element]:
                continue
            worth = float(len(text) - 2 * linked)
            while element and not self.candidate[element]:
                element = self.parent[element]
            score[element] = score.get(element, 0.0) + worth
            up = self.parent[element] if element else -1
            while up > 0 and not self.candidate[up]:
                up = self.parent[up]
            if up > 0:
                score[up] = score.get(up, 0.0) + worth / 2
        top = max(score, key=lambda e: (score[e], -e)) if score else 0
        up = top
        while up > 0 and self.tag(up) != "article":
            up = self.parent[up]
        return up if up > 0 else top  # a part of an article stands for the whole

    def tag(self, element: int) -> str:
        return self.path[element].rpartition(">")[2].split(".")[0]

    def text(self, roots: set[int]) -> str:
        """The blocks inside the roots, less doubtful containers that are mostly links; outside of articles also
        less headers and, where a root is the whole page, all doubtful ones."""
        size, linked = [0] * len(self.parent), [0] * len(self.parent)
        if any(self.soft):
            for e, t, n in self.blocks:
                size[e] += len(t)
                linked[e] += n
            for e in range(len(self.parent) - 1, 0, -1):
                size[self.parent[e]] += size[e]
                linked[self.parent[e]] += linked[e]
        whole = any(self.tag(e) in ("", "html", "body") for e in roots)
        inside = [0 in roots]
        for e in range(1, len(self.parent)):
            drop = self.soft[e] and (2 * linked[e] > size[e] or not self.kept[e] and (whole or self.tag(e) == "header"))
            inside.append(e in roots or inside[self.parent[e]] and not drop)
        return "\n".join(t for e, t, _ in self.blocks if inside[e])


def extract(source: str | None, paths: str | list[str] | None) -> str:
    """The main text, by the host's paths or the page's own best container."""
    page = Page(source or "")
    best = page.best()
    own = page.path[best]
    by = lambda p: page.text({e for e, q in enumerate(page.path) if q == p})
    paths = [] if paths is None else [paths] if isinstance(paths, str) else list(paths)
    if own and own in paths and (text := by(own)):
        return text
    text = next((t for p in paths if (t := by(p))), "")
    if not text or page.tag(best) == "article" and len(own_text := page.text({best})) > len(text):
        return page.text({best}) if not text else own_text
    return text


def votes(pages: DataFrame) -> DataFrame:
    """host, paths: the winners of each host, most votes first."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, source in zip(pdf["url"], pdf["html"], strict=True):
                if h := host(url):
                    page = Page(source or "")
                    rows.append((h, page.path[page.best()]))
            yield pd.DataFrame(rows, columns=["host", "path"])

    counted = pages.select("url", "html").mapInPandas(vote, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "votes")
    tops = counted.groupBy("host").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.expr("min_by(path, struct(-n, path))").alias("first"))
    known = join_lookup(counted, tops, "host", "path", "inner")
    won = known.where((F.col("path") == F.col("first")) | (F.col("n") >= MINOR) & (F.col("n") * 4 >= F.col("top")) & (F.col("n") * MOST >= F.col("total")))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).getField("path").alias("paths"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (long)."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = join_lookup(base.withColumn("host", found), votes(base), "host", "page_id")

    @F.pandas_udf("string")
    def read(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p) for h, p in zip(html, paths, strict=True)], dtype=object)

    texts = joined.select("page_id", "url", read("html", "paths").alias("text"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
