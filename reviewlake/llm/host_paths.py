"""Main text of pages by consensus paths of their hosts.

A page is parsed once, into its blocks of text with their generalised paths (tags, first classes or ids, digits
masked). Elements and attributes that have one meaning (nav, footer, hidden, a role) leave text out at once. Containers are
scored by the text around which they stand, without text of links; names that boilerplate often has lower a vote. Spark adds
up by host and path the votes of pages for their best containers, and each page is cut at the path with the most votes among
its own containers that hold a fair share of its best score: so a host may have several templates, and a page unlike the others
keeps its own best container. Within it Spark asks, by host and path again, what is doubtful, by five signs: a name that hints at
boilerplate, text that is mostly links, text that pages repeat, a place before or behind all other text, a few words that make no
sentence. Paths with two such signs on a host go; a name is one sign at most, half a one if it says other things too. A page without a host is a host of its own.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import small_batches, stage

# Names of elements, roles and class words.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
LEFT_OUT = {"nav", "aside", "footer", "form", "head", "svg", "math", "canvas", "object", "audio", "video", "button", "select", "dialog", "menu", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "toolbar"}
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget", "widgets", "toc",
    "header", "masthead", "footer", "foot", "copyright", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "recommendations", "form", "search", "hidden", "skip", "toolbar",
}
#: Words that say nothing of what a container holds, beside one of WORDS.
PLAIN = {"", "list", "box", "bar", "area", "wrap", "wrapper", "container", "section", "block", "links", "link", "item", "items", "inner", "main", "slot", "unit", "top", "bottom", "left", "right", "body", "content", "thread", "text"}
#: Words that tell of boilerplate as the last part of a name, whatever stands before.
LAST = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "replies", "disqus", "newsletter", "breadcrumbs", "breadcrumb", "sidebar", "navbar", "cookies"}
KEPT = {"html", "body", "article", "main"}
STRONG = {"article", "main"}
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "blockquote", "pre", "hr", "form", "nav", "aside", "header", "footer", "figure", "address", "details", "fieldset"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "body", "article", "div", "section", "select"}

#: Paths (with votes, and those cut), of some hundred bytes each, up to which they are broadcast; copies of a path in a join beyond that.
HOSTS, SALTS = 200_000, 16
#: The share of its best score that a page's container must have to be cut at.
FAIR = 0.6
#: Characters below which a text that ends no sentence counts as brief.
BRIEF = 40

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPLIT = re.compile(r"[^a-z0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text else {}


def left_out(tag: str, attr: dict[str, str], raw: str, inside_main: bool) -> bool:
    """Whether an element or attribute with one meaning leaves the text out. A header of an article or of the main part stays."""
    if tag in KEPT:
        return False
    if tag in LEFT_OUT or (tag == "header" and not inside_main):
        return True
    if not raw.strip():
        return False
    bare = ATTRIBUTE.sub(" ", raw).lower().split()
    if attr.get("role", "").lower() in ROLES or attr.get("aria-hidden", "").lower() == "true" or "hidden" in bare or "hidden" in attr:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attr.get("style", "").lower()))


def hint_of(name: str) -> int:
    """How clearly a class or id says boilerplate: 2 (a whole sign) if nothing else is in it, 1 (half a sign) if some part does, 0."""
    parts = SPLIT.split(name.lower())
    if WORDS.isdisjoint(parts):
        return 0
    return 2 if parts[-1] in LAST or all(x in WORDS or x in PLAIN for x in parts) else 1


def named(tag: str, attr: dict[str, str], inside_main: bool) -> tuple[str, int]:
    """A path's step (tag, first class and those that hint at boilerplate, or the id), and the clearest hint."""
    names = attr.get("class", "").split()
    hints = [hint_of(x) for x in names]
    kept = [x for k, x in enumerate(names) if not k or hints[k]]
    mark = "".join(f".{x}" for x in kept) if kept else f"#{attr['id']}" if attr.get("id") else ""
    hint = max([*hints, hint_of(attr.get("id", ""))])
    if tag == "header" and inside_main:  # it has the headline
        hint = 0
    return tag + re.sub("[0-9]+", "#", mark.lower()), hint


def parse(page: str) -> tuple[list[tuple[str, str]], list[tuple[str, float]], list[tuple[str, int, int, int, int, int, int]]]:
    """Blocks as (path, text) in page order, containers with a fair share of the best score (the best first), and doubtful containers.

    A doubtful container has a name that hints at boilerplate, or is mostly links: (path, hint, characters, of these in links, a
    checksum of its text, whether it stands before or behind all text of the best container that isn't doubtful, whether it is brief and no
    sentence).
    """
    blocks: list[tuple[str, str]] = []
    votes: dict[str, float] = {}
    doubtful: list[tuple[str, int, int, int, int, int, int]] = []
    # tag, path, left out, inside article or main, clearest hint from here up, own hint, [characters, linked, checksum, first block]
    stack: list[tuple[str, str, bool, bool, int, int, list[int]]] = [("", "", False, False, 0, 0, [0, 0, 0, 0])]
    text: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                tag, path, *_, doubt, _, _ = stack[-1]
                blocks.append((path, block))
                mark = zlib.crc32(block.encode("utf-8", "replace"))
                for *_, sums in stack[1:]:
                    sums[0] += len(block)
                    sums[1] += min(linked, len(block))
                    sums[2] = (sums[2] * 31 + mark) & 0x7FFFFFFF
                worth = (max(0, len(block) - 2 * linked) + 20 * block.count(",")) * (1.0, 0.6, 0.2)[doubt]
                parent = path.rpartition("/")[0] if tag in ENDS_P - {"div", "section", "article", "main"} or tag in SIBLINGS else path
                for share in (1.0, 0.5):
                    if parent:
                        votes[parent] = votes.get(parent, 0.0) + share * worth * (1.5 if re.match("article|main", parent.rpartition("/")[2]) else 1.0)
                    parent = parent.rpartition("/")[0]
        linked = 0

    def close(k: int) -> None:
        flush()
        for tag, path, *_, hint, (size, in_links, mark, first) in stack[k:]:
            if size and tag not in ("html", "body") and (hint or 2 * in_links > size):
                doubtful.append((path, hint, size, in_links, mark, first, len(blocks)))
        del stack[k:]

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at and not stack[-1][2]:
            text.append(page[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            if not stack[-1][2]:
                text.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if raw.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in ENDS_P and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif tag in SIBLINGS:
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in SCOPES:
                if stack[k][0] in SIBLINGS[tag]:
                    close(k)
                k -= 1
        flush()
        top = stack[-1]
        attr = attributes(raw)
        step, hint = named(tag, attr, top[3])
        path = f"{top[1]}/{step}" if top[1] else step
        stack.append((tag, path, top[2] or left_out(tag, attr, raw, top[3]), top[3] or tag in STRONG, max(top[4], hint), hint, [0, 0, 0, len(blocks)]))
    close(1)
    flush()
    ranked = sorted(votes.items(), key=lambda v: (-v[1], v[0]))
    fair = [v for v in ranked if v[1] >= FAIR * ranked[0][1]]
    unsure = {k for *_, first, end in doubtful for k in range(first, end)}
    whole = [k for k, (path, _) in enumerate(blocks) if fair and k not in unsure and f"{path}/".startswith(f"{fair[0][0]}/")]
    edge = lambda first, end: int(bool(whole) and (end <= whole[0] or first > whole[-1]))
    brief = lambda size, end: int(size < BRIEF and blocks[end - 1][1][-1] not in ".!?")
    return blocks, fair, [(*d[:5], edge(*d[5:]), brief(d[2], d[6])) for d in doubtful]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parsed_pages(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, containers (path and score, the best first), blocks, doubtful, mark (a checksum). Null html has no blocks."""
    kind = dict(pages.dtypes)["page_id"]
    block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    container = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())]))
    names = ("path", "hint", "size", "linked", "mark", "edge", "brief")
    doubt = pa.list_(pa.struct([("path", pa.string()), ("hint", pa.int32()), ("size", pa.int64()), ("linked", pa.int64()), ("mark", pa.int64()), ("edge", pa.int32()), ("brief", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string()), pa.array([[{"path": p, "score": v} for p, v in f[1]] for f in found], container),
                    pa.array([[{"path": p, "text": t} for p, t in f[0]] for f in found], block), pa.array([[dict(zip(names, d, strict=True)) for d in f[2]] for f in found], doubt),
                    pa.array([zlib.crc32("\n".join(t for _, t in f[0]).encode("utf-8", "replace")) for f in found], pa.int64()),
                ], ["page_id", "url", "host", "containers", "blocks", "doubtful", "mark"],
            )

    schema = f"page_id {kind}, url string, host string, containers array<struct<path:string,score:double>>, blocks array<struct<path:string,text:string>>, doubtful array<struct<path:string,hint:int,size:long,linked:long,mark:long,edge:int,brief:int>>, mark long"
    with small_batches(pages.sparkSession, 500):
        parsed = stage(pages.select("page_id", "url", "html").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "pages")
    return parsed.withColumn("host", F.when(F.col("host") == "", F.concat(F.lit(" "), F.col("row").cast("string"))).otherwise(F.col("host")))


def host_votes(parsed: DataFrame) -> DataFrame:
    """host, path, votes: of pages for their best containers, a page's vote growing with the logarithm of its score."""
    best = parsed.select("host", F.get("containers", F.lit(0)).alias("b")).where("b is not null")
    return best.groupBy("host", F.col("b.path").alias("path")).agg(F.round(F.sum(F.log1p("b.score")), 6).alias("votes"))


def host_cuts(parsed: DataFrame) -> DataFrame:
    """host, path: what two signs of five call boilerplate on a host: its name, links, repeated text, a place at the edge of the main text, a few words."""
    each = parsed.select("host", F.col("mark").alias("page"), F.explode("doubtful").alias("d")).select("host", "page", "d.*")
    by = each.groupBy("host", "path").agg(
        (F.avg("hint") / 2).alias("named"), (2 * F.sum("linked") > F.sum("size")).cast("int").alias("links"), (F.avg("edge") > 0.5).cast("int").alias("edge"), (F.avg("brief") > 0.5).cast("int").alias("brief"),
        F.count_distinct("page").alias("pages"), F.count_distinct("mark").alias("texts"),
    )
    same = ((F.col("pages") >= 3) & (2 * F.col("texts") <= F.col("pages"))).cast("int")
    return by.where(F.col("named") + F.col("links") + F.col("edge") + F.col("brief") + same >= 2).select("host", "path")


def with_hosts(parsed: DataFrame, votes: DataFrame, cuts: DataFrame) -> DataFrame:
    """parsed with votes (by path) and cuts (paths) of its host: of the whole host, by a broadcast, or of the page's own paths alone.

    Few paths in all are broadcast, so that no text is shuffled. Else the pages' paths meet them, a path in SALTS copies, since one host
    may have a third of all pages, and what is found goes back to the pages by their row. A page's own paths are those of its blocks and all
    above them: no other path can hold text of the page, so both ways cut it alike, also by what only other pages of its host call doubtful.
    """
    every = votes.unionByName(cuts, allowMissingColumns=True)
    pair = F.struct("path", "votes")
    packed = lambda df, *keys: df.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.when(F.col("votes").isNotNull(), pair))).alias("votes"), F.sort_array(F.collect_set(F.when(F.col("votes").isNull(), F.col("path")))).alias("cuts"))
    if every.count() <= HOSTS:
        return parsed.join(F.broadcast(packed(every, "host")), "host", "left")
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.call_function("substring_index", p, F.lit("/"), k))
    own = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform("blocks", lambda b: b["path"])), above)))
    asked = parsed.select("row", "host", F.explode(own).alias("path")).withColumn("salt", F.col("row") % SALTS)
    copies = every.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return parsed.join(packed(asked.join(copies, ["host", "path", "salt"]), "row"), "row", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for every row.

    Null or textless html has an empty text; a page without a url, or with a broken one, stands alone; repeated rows get equal texts and
    don't make a text a repeated one; other columns, whatever their names, don't matter; an empty table gives no rows.
    """
    parsed = parsed_pages(pages)
    votes, cuts = stage(host_votes(parsed), "votes"), stage(host_cuts(parsed), "cuts")
    found = with_hosts(parsed, votes, cuts)
    below = lambda path, of: F.startswith(F.concat(path, F.lit("/")), F.concat(of, F.lit("/")))
    rank = F.transform("containers", lambda c, k: F.struct(F.coalesce(F.element_at("votes", c["path"]), F.lit(0.0)).alias("votes"), (-k).alias("k"), c["path"].alias("path")))
    found = found.withColumn("path", F.coalesce(F.array_max(rank)["path"], F.lit("")))
    found = found.withColumn("cuts", F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: ~below(F.col("path"), c)))  # what holds the main text isn't cut
    kept = F.filter("blocks", lambda b: below(b["path"], F.col("path")) & ~F.exists("cuts", lambda c: below(b["path"], c)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    found = found.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"), "path")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
