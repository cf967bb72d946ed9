"""HTML extraction by consensus host paths: each page scores its containers, pages vote in Spark on generalised
tag-class paths per host, and pages are extracted again by their host's winning paths.

A path is the tags and classes from the root to a container, with digits made alike, so that pages of one
template share it. A page in which no winning path holds nearly all of what its own best container holds is
extracted by that container: the smallest one with all of the page's text beyond links and junk, so that parts that
lie beside each other stay together.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C

#: Paths that a page votes for, and that win a host; votes a winner needs against the first.
PAGE_VOTES, HOST_PATHS, LEAST_VOTE = 3, 3, 0.1
#: Share of its own best container's score that a winning path must hold in a page.
FAIR_SHARE = 0.9
#: Characters of winning paths that are broadcast; beyond, pages are joined to them by host and salt.
BROADCAST_CHARS, SALTS = 16_000_000, 64
OUTPUTS = ("text", "n_chars")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg title iframe xmp noembed noframes annotation annotation-xml".split())
_GONE = _RAW | frozenset("head nav header footer aside form button select option datalist object canvas dialog menu audio video map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math semantics mi mo mn ms mtext mrow mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mpadded".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption summary caption".split())
_TRANSPARENT = frozenset("ul ol dl table thead tbody tfoot tr li dt dd p h1 h2 h3 h4 h5 h6 figure picture".split()) | _INLINE
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag closes an open element of these, up to a border.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_JUNK = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar aside widget widgets recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager skip copyright disclaimer".split())
#: "related" in the name of a list of links; a section of an article may be called related-work.
_RELATED = re.compile(r"\brelated(?:[-_ ]?(?:posts?|articles?|links?|content|stor(?:y|ies)|items?|news|reading|products?|topics?|pages?|list|box|widget))?(?![-_\w])", re.I)
_REPLIES = frozenset("comment comments disqus reply replies respond discussion".split())
_GOOD = frozenset("article content main post story entry body text page".split())
#: Headers of an article hold its headline.
_HEADS = frozenset("header masthead".split())
#: Words before and after such a name with which a class tells how the page is laid out: has-sidebar, comments-open.
_FLAGS, _STATES = frozenset("has with no without show hide".split()), frozenset("open opened closed enabled disabled on off visible active".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_JUNK_NAME = re.compile(r"^(?:nav(?!y)|advert|adbox|adslot|sponsor|cookie|breadcrumb|newsletter|sidebar)|(?:nav|menu|sidebar)$")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Elements in page order, parents first, and blocks of text with the element that holds each."""

    tags: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    codes: list[int] = field(default_factory=list)  # a hash of the path, of this process
    parents: list[int] = field(default_factory=list)
    gone: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links

    def path(self, at: int) -> str:
        steps = []
        while at >= 0:
            steps.append(self.steps[at])
            at = self.parents[at]
        return ">".join(reversed(steps))

    def scores(self) -> dict[int, float]:
        """Text beyond links inside each container, more for articles. Lists, tables and their rows aren't containers,
        and neither is what only wraps a container that holds as much."""
        worth, most = [0.0] * len(self.tags), [0.0] * len(self.tags)
        for at, text, linked in self.blocks:
            if self.tags[at] in _PARAGRAPH and self.parents[at] >= 0:
                at = self.parents[at]
            worth[at] += max(0, len(text) - 2 * linked)
        out: dict[int, float] = {}
        for at in range(len(self.tags) - 1, -1, -1):
            score = worth[at] * (1.3 if self.tags[at] in ("article", "main") else 1.0)
            if score > most[at] and self.tags[at] not in _TRANSPARENT:
                out[at] = most[at] = score
            if (up := self.parents[at]) >= 0:
                worth[up] += worth[at]
                most[up] = max(most[up], most[at])
        return out

    def inside(self, roots: set[int]) -> list[str]:
        """The blocks under the roots, and the heading of the page if it stands before them and they have none."""
        under = [False] * len(self.tags)
        for k, parent in enumerate(self.parents):
            under[k] = k in roots or (parent >= 0 and under[parent])
        own = [k for k, (at, _, _) in enumerate(self.blocks) if under[at]]
        heads = [k for k, (at, _, _) in enumerate(self.blocks) if self.tags[at] == "h1"]
        if own and not any(under[self.blocks[k][0]] for k in heads):
            own = [k for k in heads if k < own[0]][-1:] + own
        return [self.blocks[k][1] for k in own]


def path_code(path: str) -> int:
    code = 0
    for step in path.split(">"):
        code = hash((code, step))
    return code


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _is_junk(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _GONE:
        return True
    if tag in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
        return True
    own = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = [[x.lower() for x in _NAME.findall(token)] for token in own.split()]
    if any(_names(x, _is_reply) for x in words):
        return True
    if tag in ("article", "main"):
        return False
    junk = [_names(x, _is_junk_word) and ((_is_junk_word(x[-1]) and x[-1] not in _HEADS) or _GOOD.isdisjoint(x)) for x in words]
    # main-menu is a menu and page-footer a footer, but an element of several names is what its good one says
    return bool(_RELATED.search(own)) or (any(junk) and all(bad or _GOOD.isdisjoint(x) for bad, x in zip(junk, words, strict=True)))


def _is_reply(word: str) -> bool:
    return word in _REPLIES or word.startswith("comment")


def _is_junk_word(word: str) -> bool:
    return word in _JUNK or bool(_JUNK_NAME.search(word))


def _names(words: list[str], is_one: Callable[[str], bool]) -> bool:
    """Whether a class or id names such a thing, and not only that the page has one or what state it is in."""
    at = next((k for k, x in enumerate(words) if is_one(x)), None)
    return at is not None and _FLAGS.isdisjoint(words[:at]) and not (words[-1] in _STATES and at < len(words) - 1)


def parse(source: str) -> Page:
    """Reads whole pages of any length in one go, however broken: unknown end tags are ignored, open elements
    end with their parents, an unclosed comment or script reaches to the end."""
    page, stack, size = Page(), [], len(source)
    pieces: list[str] = []
    state = {"owner": -1, "linked": 0}
    opened: Counter[str] = Counter()
    links = 0

    def close_block() -> None:
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((state["owner"], text, min(state["linked"], len(text))))
            pieces.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if stack and not page.gone[stack[-1]]:
            if not pieces:
                state["owner"] = next((k for k in reversed(stack) if page.tags[k] not in _INLINE), stack[0])
            pieces.append(text)
            if links:
                state["linked"] += len(text.strip())

    def pop_to(depth: int) -> None:
        nonlocal links
        for k in stack[depth:]:
            if page.tags[k] not in _INLINE:
                close_block()
            links -= page.tags[k] == "a"
            opened[page.tags[k]] -= 1
        del stack[depth:]

    def open_depth(wanted: set[str], borders: set[str] | frozenset[str]) -> int:
        for depth in range(len(stack) - 1, -1, -1) if any(opened[t] for t in wanted) else ():
            if page.tags[stack[depth]] in wanted:
                return depth
            if page.tags[stack[depth]] in borders:
                return -1
        return -1

    def push(tag: str, attributes: dict[str, str]) -> None:
        nonlocal links
        parent = stack[-1] if stack else -1
        classes = ".".join(sorted({_DIGITS.sub("N", x.lower()) for x in attributes.get("class", "").split()}))
        step = (f"{tag}.{classes}" if classes else tag).replace(">", "_")
        page.tags.append(tag)
        page.steps.append(step)
        page.codes.append(hash((page.codes[parent] if parent >= 0 else 0, step)))
        page.parents.append(parent)
        # an article's own header holds its headline
        headline = tag == "header" and any(page.tags[k] == "article" for k in stack)
        page.gone.append((parent >= 0 and page.gone[parent]) or (not headline and _is_junk(tag, attributes)))
        stack.append(len(page.tags) - 1)
        links += tag == "a"
        opened[tag] += 1

    push("html", {})
    at = 0
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        if lt > at:
            add(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        follows = source[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            end = source.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        if not (follows.isascii() and follows.isalpha()) and not (follows == "/" and source[lt + 2 : lt + 3].isalpha()):
            add("<")
            at = lt + 1
            continue
        m = _TAG.match(source, lt)
        if m:
            closing, tag, raw, at = m[1], m[2].lower(), m[3], m.end()
        else:  # a quote that doesn't end
            end = source.find(">", lt)
            if end < 0:
                break
            m = re.match(r"</?([a-zA-Z][^\s/>]*)", source[lt : end + 1])
            closing, tag, raw, at = source[lt + 1 : lt + 2].replace("<", "") if follows == "/" else "", m[1].lower(), "", end + 1
        if closing:
            if tag not in ("html", "body"):
                border = frozenset() if tag not in _INLINE else _PARAGRAPH
                depth = open_depth({tag}, border)
                if depth > 0:
                    pop_to(depth)
                elif tag not in _INLINE:
                    close_block()
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P and (depth := open_depth({"p"}, {"table", "td", "th", "button", "object"})) > 0:
            pop_to(depth)
        if tag in _SIBLINGS and (depth := open_depth(*_SIBLINGS[tag])) > 0:
            pop_to(depth)
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                close_block()
            continue
        attributes = _attributes(raw) if raw.strip() else {}
        if tag in _RAW:
            if not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                if not end:
                    break
                close = source.find(">", end.start())
                at = size if close < 0 else close + 1
            continue
        if tag not in _INLINE:
            close_block()
        push(tag, attributes)
    close_block()
    return page


def best_containers(page: Page, most: int = PAGE_VOTES) -> list[tuple[int, float]]:
    return sorted(page.scores().items(), key=lambda x: (-x[1], -x[0]))[:most]


def extract(source: str | None, paths: list[str] | None = None) -> str:
    """The main text by the path that holds most, if that is a fair share, else by the page's best container."""
    page = parse(source or "")
    scores = page.scores()
    if not scores:
        return "\n\n".join(text for _, text, _ in page.blocks)
    top = min(scores, key=lambda k: (-scores[k], -k))
    held, best = 0.0, {top}
    for path in paths or []:
        code = path_code(path)
        roots = {k for k, c in enumerate(page.codes) if c == code and not page.gone[k] and page.path(k) == path}
        share = sum(scores.get(k, 0.0) for k in roots)
        if roots and share > held and share >= FAIR_SHARE * scores[top]:
            held, best = share, roots
    return "\n\n".join(page.inside(best))


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            page = parse(source.as_py() or "")
            found = best_containers(page)
            total = sum(s for _, s in found)
            for k, score in found:
                hosts.append(host.as_py())
                paths.append(page.path(k))
                votes.append(score / total)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], names=["host", "path", "vote"])


def _extractor(html_name: str, paths_name: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts = [extract(s.as_py(), p.as_py()) for s, p in zip(batch.column(at(html_name)), batch.column(at(paths_name)), strict=True)]
            made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), *made], names=[*names, *OUTPUTS])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): the paths that win each host's vote, best first; a host's votes are rounded so that the
    order in which they are summed doesn't matter."""
    slim = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = slim.mapInArrow(_voter, "host string, path string, vote double").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    # a rank below a limit is cut off in every partition before the hosts' paths meet
    by = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= HOST_PATHS)
    best = ranked.groupBy("host").agg(F.max("votes").alias("top"), F.array_sort(F.collect_list(F.struct("rank", "votes", "path"))).alias("all"))
    winners = F.filter("all", lambda x: x["votes"] >= LEAST_VOTE * F.col("top"))
    return best.select("host", F.transform(winners, lambda x: x["path"]).alias("paths"))


def extract_pages(df: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all if None) with text and n_chars: the main text of each page, blocks in page
    order joined by two newlines.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader
    comments go; character references are decoded and white space inside a block is one space. A null or empty
    page gives an empty text; pages without a host (null urls too) form one host; repeated rows get equal texts; pages
    of any length and depth are read whole; an empty table gives an empty result. Of containers with equal scores the
    inner one counts, of paths with equal votes the first by name. Input columns named like an output are replaced;
    other columns stay, however named.
    """
    df = C.without(df, [x for x in OUTPUTS if x not in (url_col, html_col)])
    names = [n for n in (keep if keep is not None else df.columns) if n not in OUTPUTS]
    host, paths, salt = (C.free_name(df.columns, x) for x in ("host", "paths", "salt"))
    winners = C.checkpointed(host_paths(df, url_col, html_col)).select(F.col("host").alias(host), F.col("paths").alias(paths))
    hosted = df.select(*dict.fromkeys([*names, html_col])).withColumn(host, host_of(F.col(url_col))) if url_col in names else df.withColumn(host, host_of(F.col(url_col)))
    chars = winners.agg(F.sum(F.length(host) + F.length(F.array_join(paths, ">")))).first()[0] or 0
    if chars <= BROADCAST_CHARS:
        met = hosted.join(F.broadcast(winners), host, "left")
    else:
        salted = winners.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hosted.withColumn(salt, F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left")
    out = T.StructType([*(df.schema[n] for n in names), C.field("text", T.StringType()), C.field("n_chars", T.LongType())])
    return met.select(*dict.fromkeys([*names, html_col]), paths).mapInArrow(_extractor(html_col, paths, names), out)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(C.table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
