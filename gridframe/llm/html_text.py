"""Main text of web pages, with a suffix array over each host's token streams.

A page is cut into blocks. Markup settles two kinds: what stands in ``article`` or
``main`` is content and stays; what stands in menus, headers, footers, sidebars, adverts,
forms, comments and the like goes. Everything else is decided by repetition: blocks
outside of the article, blocks of pages without one, and blocks in the article whose class
only hints at boilerplate. An ``article`` inside of an element that markup removes (a teaser in a
sidebar, a reader's comment) goes with it, unless that element is never closed.

The token streams of all that is outside the settled article, on every page, are
concatenated by host. Prefix doubling names the suffixes by their first 3, 6, 12, ...
tokens; equal names are an interval of the suffix array whose longest common prefix is at
least that long, and only intervals on ``min_pages`` distinct pages of the host go on to the
next level. Covered are the tokens of all repeated substrings of ``long_tokens`` or more on so
many pages, and of ``min_tokens`` or more if they are also on the share ``host_share`` of
the host's pages, so that common phrases of a large host are no boilerplate. Covered
tokens are removed, unique runs stay in their place. Blocks that markup removes
take part, so a menu or notice that one page marks is also known where another does not.

Pages of a host with the same stream are one row of the array with their number, so a
template costs once whatever the size of its host. Intervals are counted by partial
aggregation, so a notice on every page of a hot host is no hot key.

Defined results: null or empty html gives an empty text; a null url is a host of its
own name ""; pages with the same html are one page for counting, so a page that occurs
twice does not make itself boilerplate, and repeated rows give repeated results; very long
pages are read whole; extra columns of any name are left aside; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, spread

#: Tokens of a repeat that counts if it is on so many pages and on this share of its host's pages.
MIN_TOKENS = 6
MIN_PAGES = 3
HOST_SHARE = 0.05
#: Tokens of a repeat that counts on so few pages of any host.
LONG_TOKENS = 24
#: Covered ranges that are broadcast to their pages; more are joined by a shuffle.
MAX_BROADCAST = 500_000
CONTENT, LOOSE, MARKED, DOUBTFUL = 0, 1, 2, 3

#: Elements that hold no main text (fixed values).
DROPPED = set("nav footer aside form script style noscript template iframe object embed button select option textarea input label fieldset svg canvas video audio dialog menu head title".split())
#: Elements whose content is no text at all (fixed values).
RAW = set("script style textarea title noscript template iframe svg".split())
#: Whole words of class and id, and roles, that say what an element is (fixed values).
SURE = set("nav navbar navigation menu menubar sidebar footer masthead ad ads adv advert adverts advertisement advertisements sponsored promo cookie cookies cookie-notice cookie-banner cookie-consent cookie-bar consent gdpr newsletter newsletter-signup subscribe subscribe-box signup login popup modal overlay breadcrumb breadcrumbs comment comments comment-list comment-form comments-area comments-section disqus disqus_thread reply replies share sharing share-buttons social social-share toolbar pagination pager copyright site-header site-footer site-nav main-nav main-menu nav-menu ad-slot ad-banner ad-container widget widgets related-posts related-articles recommended contentinfo complementary".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: Words and parts of words of class and id that only hint at it (fixed values).
HINTS = set("nav navbar navigation menu menubar sidebar footer header masthead ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs comment comments disqus reply replies share sharing social related recommended widget toolbar pagination pager copyright search skip".split())
#: Joined and hyphenated names of readers' comments, and parts that make them a state of something else.
COMMENT = re.compile(r"(?:^|[-_])comments?(?:$|[-_])|^comments?(?:list|box|form|section|area|thread|body|wrap|wrapper|container)|comments$")
STATES = set("no has with without open closed enabled disabled on off".split())
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul option center".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SPACES = {"br", "td", "th", "wbr", "img"}
#: Start tags that end an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPES = {"article", "main", "div", "section", "body", "table", "ul", "ol", "blockquote"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")


def judged(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """(CONTENT, DOUBTFUL or MARKED as the start tag says; whether it opens the main text)."""
    names = {}
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            names.setdefault(name.lower(), "".join(values).lower())
    role = names.get("role", "")
    opens = tag in ("article", "main") or role in ("main", "article")
    if names.get("aria-hidden") == "true" or HIDDEN_STYLE.search(names.get("style", "")) or attributes and HIDDEN.search(ATTRIBUTE.sub(" ", attributes)):
        return MARKED, False
    if opens and not inside:
        return CONTENT, True
    if tag in DROPPED or role in ROLES or tag == "header" and not inside:
        return MARKED, False
    if tag in ("body", "html"):
        return CONTENT, False
    words = f"{names.get('class', '')} {names.get('id', '')}".split()
    if not SURE.isdisjoint(words) or any("comment" in w and COMMENT.search(w) and STATES.isdisjoint(re.split("[-_]", w)) for w in words):
        return MARKED, False
    if words and tag in BLOCKS and not HINTS.isdisjoint(WORD.findall(" ".join(words))):
        return DOUBTFUL, opens
    return CONTENT, opens


def judged_marked(page: str, start: int) -> bool:
    """Whether the start tag there is removed for what it says itself."""
    token = TOKEN.match(page, start)
    return judged(token[2].lower(), token[3], False)[0] == MARKED


def is_closed(page: str, at: int, tags: list[str]) -> bool:
    """Whether the first of the open ``tags`` ends after ``at``."""
    depth = tags.count(tags[0])
    for m in re.finditer(rf"<(/?){re.escape(tags[0])}(?=[\s/>])", page[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(CONTENT, LOOSE or MARKED, text) of each block, in page order."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, judged, inside the main text
    closed: dict[tuple[int, int], bool] = {}  # of elements that markup removes, by depth and start
    begins: list[int] = []  # where each open element starts
    pieces: list[str] = []
    aside: list[str] = []
    state, inside, opened = CONTENT, False, False

    def flush() -> None:
        kind = CONTENT if inside else LOOSE
        if state == DOUBTFUL:
            kind = LOOSE if inside else DOUBTFUL
        for kind, texts in ((kind, pieces), (MARKED, aside)):
            if texts:
                text = " ".join(entities.unescape("".join(texts)).split())
                texts.clear()
                if text:
                    found.append((kind, text))

    def pop_to(k: int) -> None:
        nonlocal state, inside
        flush()
        del stack[k:], begins[k:]
        state, inside = (stack[-1][1], stack[-1][2]) if stack else (CONTENT, False)

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.match(page, at)
        if token is None:  # "<" of a tag that never ends
            if page[at] != "<":
                (aside if state == MARKED else pieces).append(page[at])
            at += 1
            continue
        at = token.end()
        text = token[4]
        if text is not None:
            (aside if state == MARKED else pieces).append(text if text != "<" else "&lt;")
            continue
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS or tag in DROPPED and stack[k][1] == MARKED and k and stack[k - 1][1] == MARKED:
                        pop_to(k)
                    elif not any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        del stack[k:], begins[k:]
                        state, inside = (stack[-1][1], stack[-1][2]) if stack else (CONTENT, False)
                    break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS.get(tag, ()) or stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in SCOPES:
                    break
            flush()
        elif tag in SPACES:
            (aside if state == MARKED else pieces).append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        own, opens = judged(tag, token[3], inside)
        if opens and not opened and state == MARKED:  # only inside of elements that are never closed
            for k, (_, kind, _) in enumerate(stack):
                if kind == MARKED and (not k or stack[k - 1][1] != MARKED or judged_marked(page, begins[k])):
                    key = (k, begins[k])
                    if key not in closed:
                        closed[key] = is_closed(page, at, [t for t, _, _ in stack[k:]])
                    opens = opens and not closed[key]
        if opens and not opened:
            state, inside, opened = CONTENT, True, True
        else:
            state = MARKED if MARKED in (own, state) else max(own, state)
            inside = (inside or opens) and state != MARKED
        stack.append((tag, state, inside))
        begins.append(token.start())
    flush()
    settled = any(kind == CONTENT for kind, _ in found)
    return [((MARKED if settled else LOOSE) if kind == DOUBTFUL else kind, text) for kind, text in found]


#: Stands in a stream where the main text was.
GAP = "\n"


def outside(found: list[tuple[int, str]]) -> str:
    """Token stream of the blocks that are not content."""
    out: list[str] = []
    for kind, text in found:
        if kind != CONTENT:
            out.append(text)
        elif out and out[-1] != GAP:
            out.append(GAP)
    return " ".join(out[:-1] if out and out[-1] == GAP else out)


def unique(found: list[tuple[int, str]], covered: list[tuple[int, int]]) -> str:
    """Content, and what no range of covered tokens of the stream removes from loose blocks."""
    out, at, gap, last = [], 0, False, len(covered)
    k = 0
    for kind, text in found:
        if kind == CONTENT:
            out.append(text)
            gap = at > 0
            continue
        at += gap  # the token of the gap
        gap = False
        words = text.split(" ")
        if kind == LOOSE:
            left = []
            j = k
            for n, word in enumerate(words, at):
                while j < last and covered[j][1] <= n:
                    j += 1
                if j == last or n < covered[j][0]:
                    left.append(word)
            if left:
                out.append(" ".join(left))
        at += len(words)
        while k < last and covered[k][1] <= at:
            k += 1
    return "\n\n".join(out)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(own: DataFrame) -> DataFrame:
    """(page_id, url, host, page, text, loose, kinds, texts): blocks of each page, the stream of what is outside the main text, and whether some of it is to be decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [blocks(p) if p else [] for p in batch.column("html").to_pylist()]
                kept = {c: batch.column(c) for c in ("page_id", "url", "host", "page")}
                lists = {"kinds": pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())), "texts": pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict({**kept, "text": pa.array(map(outside, found), pa.string()), "loose": [any(kind == LOOSE for kind, _ in f) for f in found], **lists})

    return own.select("page_id", "url", "host", "page", "html").mapInArrow(run, "page_id long, url string, host string, page long, text string, loose boolean, kinds array<int>, texts array<string>")


def shared(suffixes: DataFrame, min_pages: int) -> DataFrame:
    """Suffixes in the intervals (equal names) that lie on at least ``min_pages`` pages, and on how many: ``n``."""
    once = suffixes.groupBy("h1", "h2", "stream").agg(F.first("pages").alias("pages"))  # however often in one stream
    wide = once.groupBy("h1", "h2").agg(F.sum("pages").alias("n")).where(F.col("n") >= min_pages)
    wide = materialize(wide.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), "n"), "page-intervals")
    return suffixes.join(wide, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))).drop("w1", "w2")


def doubled(suffixes: DataFrame, size: int) -> DataFrame:
    """Names of ``2 * size`` tokens from those of ``size``."""
    after = Window.partitionBy("stream").orderBy("at").rangeBetween(size, size)
    pairs = suffixes.withColumn("b", F.first(F.struct("h1", "h2")).over(after)).where(F.col("b").isNotNull())
    return pairs.select("stream", "pages", "least", "at", F.xxhash64("h1", "b.h1").alias("h1"), F.hash("h2", "b.h2").alias("h2"))


def stream_classes(found: DataFrame, host_share: float) -> DataFrame:
    """(stream, host, text, pages, least) of (host, text, page): different streams, pages they are on, pages a short repeat needs."""
    once = found.groupBy("host", "text", "page").agg(F.lit(1).alias("one"))
    classes = materialize(once.groupBy("host", "text").agg(F.count("*").alias("pages")), "page-streams")
    hosts = materialize(classes.groupBy(F.col("host").alias("c_host")).agg(F.ceil(F.sum("pages") * host_share).alias("least")), "page-hosts")
    return materialize(classes.join(hosts, F.col("host") == F.col("c_host")).select(F.monotonically_increasing_id().alias("stream"), "host", "text", "pages", "least"), "page-classes")


def suffix_levels(classes: DataFrame, min_tokens: int, min_pages: int, long_tokens: int) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes (stream, pages, least, at, n) in intervals of that depth), from ``min_tokens`` to ``long_tokens``."""
    size = min_tokens // 2
    words = classes.select("stream", "host", "pages", "least", F.split("text", " ").alias("words")).where(F.size("words") >= size)
    heads = words.select("stream", "host", "pages", "least", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    head = F.slice("words", F.col("at") + 1, size)
    named = heads.where(~F.array_contains(head, GAP)).select("stream", "pages", "least", "at", F.xxhash64("host", head).alias("h1"), F.hash("host", head).alias("h2"))
    level, found = materialize(shared(named, min_pages), "page-suffixes"), []
    while size < long_tokens:
        level = materialize(shared(doubled(level, size), min_pages), "page-suffixes")
        size *= 2
        found.append((size, level))
    return found


def covered_ranges(classes: DataFrame, min_tokens: int, min_pages: int, long_tokens: int) -> DataFrame:
    """(c_stream, covered): sorted ranges (first token, end) that make the covered tokens of a stream."""
    parts = []
    for size, level in suffix_levels(classes, min_tokens, min_pages, long_tokens):
        wide = level if size >= long_tokens else level.where(F.col("n") >= F.col("least"))
        parts.append(wide.select("stream", F.struct(F.col("at").alias("a"), (F.col("at") + size).alias("b")).alias("r")))
    ranges = parts[0]
    for part in parts[1:]:
        ranges = ranges.union(part)
    return ranges.groupBy(F.col("stream").alias("c_stream")).agg(F.array_sort(F.collect_list("r")).alias("covered"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Disjoint ranges of the same tokens, in order."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        if out and r["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["b"]))
        else:
            out.append((r["a"], r["b"]))
    return out


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, long_tokens: int = LONG_TOKENS, host_share: float = HOST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    if min_tokens % 2 or long_tokens % min_tokens or (long_tokens // min_tokens).bit_count() != 1:
        raise ValueError("min_tokens is even, and long_tokens a doubling of it")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    own = materialize(parsed(spread(own)), "page-blocks")
    found = own.where("text <> ''").select("host", "page", "text", "loose")
    classes = stream_classes(found, host_share)
    covered = covered_ranges(classes, min_tokens, min_pages, long_tokens)
    covered = materialize(classes.join(covered, F.col("stream") == F.col("c_stream")).select(F.col("host").alias("k_host"), F.col("text").alias("k_text"), "covered"), "page-covered")
    open_pages = found.where("loose").select("host", "text", "page").distinct()
    decided = open_pages.join(covered, (F.col("host") == F.col("k_host")) & (F.col("text") == F.col("k_text"))).select(F.col("host").alias("d_host"), F.col("page").alias("d_page"), "covered")
    decided = materialize(decided, "page-decided")
    size = decided.agg(F.coalesce(F.sum(F.size("covered") + 1), F.lit(0))).first()[0]
    decided = F.broadcast(decided) if size <= MAX_BROADCAST else decided.hint("merge")
    met = own.join(decided, (F.col("host") == F.col("d_host")) & (F.col("page") == F.col("d_page")), "left").select("page_id", "url", "kinds", "texts", "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = zip(*(batch.column(c).to_pylist() for c in ("kinds", "texts", "covered")))
                texts = [unique(list(zip(kinds, parts)), merged(ranges or [])) for kinds, parts, ranges in rows]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
