"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one for each block element. Each page is paired with the page of the same
host whose URL path is nearest in the order of path segments and whose content is another, the two
pages' lines are aligned by longest common subsequence, and shared lines are deleted as the site's
template. Copies (equal or nearly equal pages) tell nothing of the template and are passed over.

What markup says outright goes first: lines of navigation, headers, footers, asides, forms, scripts,
hidden parts and of blocks named as adverts, notices or comments. Inside an <article> or <main> shared
lines go if they are mostly links, or if the rest of the article, at least half of it, differs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import map_arrow, materialize, shuffle_partitions

# Element names by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul head option select".split())
#: Never part of the article, whatever they hold.
DROPPED = frozenset("noscript template iframe object svg canvas button select dialog video audio map math".split())
#: Left out as well, unless they hold the article (see ``_wanted``); a header only outside articles.
ASIDES = frozenset("nav footer aside menu".split())
RAW = frozenset("title script style textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "wbr"))
#: A block whose class, id or role has one of these words is not part of the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted sidebar sidebars aside"
    " comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert newsletter subscribe"
    " signup popup modal overlay menu menus navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar social share sharing related recommended"
    " widget widgets pagination pager skip login search contentinfo complementary".split())

#: Of these, words for readers' texts, which may well be longer than the article.
REMARKS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: A class or id of a wrapper that says what its page has: "has-sidebar", "no-sidebar", "comment-open".
_STATE = re.compile(r"(?:has|no|not|with|without|is)[^a-z0-9].*|.*[^a-z0-9](?:open|opened|closed|on|off|enabled|disabled|none)")
#: Characters from which on the text of a named block can be a whole page's text.
LEAST = 200

# Where HTML implies the end of an open element.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
_CELLS = frozenset("td th".split())
_ROWS = _CELLS | {"tr"}
_SECTIONS = _ROWS | frozenset("thead tbody tfoot caption colgroup".split())
#: Opening tag: the open elements that it ends, and the elements beyond which it doesn't look.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
            "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
            "td": (_CELLS, {"table"}), "th": (_CELLS, {"table"}), "tr": (_ROWS, {"table"}),
            **{x: (_SECTIONS, {"table"}) for x in ("thead", "tbody", "tfoot")}, "body": ({"head"}, frozenset())}
_IN_HEAD = RAW | frozenset("head base basefont bgsound link meta noscript template".split())
_SCOPES = frozenset("td th caption table button object template html".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(attributes: str) -> str:
    """What the attributes say of an element: "dropped" if it is hidden, "remark" or "named" by its names, else "" ."""
    found = ""
    if "=" not in attributes and "hidden" not in attributes:
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words = {w for x in value.split() if not _STATE.fullmatch(x) for w in re.split(r"[^a-z0-9]+", x)}
            if not REMARKS.isdisjoint(words):
                found = "remark"
            elif not found and not NAMED.isdisjoint(words):
                found = "named"
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return "dropped"
    return found


def _implied_end(stack: list[tuple[str, int]], opened: dict[str, int], name: str) -> int:
    """Number of elements that stay open before a tag that opens ``name``; ``opened`` counts the open ones by name."""
    keep = len(stack)
    if name not in _IN_HEAD and stack and stack[-1][0] == "head":
        keep -= 1
    if name in _ENDS_P and opened.get("p"):
        for i in range(keep - 1, -1, -1):
            if stack[i][0] == "p":
                keep = i
                break
            if stack[i][0] in _SCOPES:
                break
    ended, beyond = _IMPLIED.get(name, ((), ()))
    for i in range(keep - 1, -1, -1) if any(opened.get(x) for x in ended) else ():
        if stack[i][0] in beyond:
            break
        if stack[i][0] in ended:
            keep = i
    return keep


def _end(stack: list[tuple[str, int]], opened: dict[str, int], name: str) -> int:
    """Number of elements that stay open after the end tag of ``name``; one without an open element ends nothing."""
    for i in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
        if stack[i][0] == name:
            return i
        if name not in BLOCKS and stack[i][0] in BLOCKS:
            break
        if stack[i][0] == "table" or (stack[i][0] in _SCOPES and name not in _SECTIONS and name != "table"):
            break
        if name == "li" and stack[i][0] in ("ul", "ol", "menu", "dir"):
            break
    return len(stack)


def _wanted(regions: list[list], lines: list[tuple]) -> list[bool]:
    """Which regions (kind, outer region, number of articles and of mains in it) stay, as they hold the article.

    A region stays if the page's <main> or only <article> is in it, or, being a form or a block with a
    telling name, if it holds most of the text: that in articles where the page has some outside of regions.
    """
    stays = [True] + [False] * (len(regions) - 1)
    if len(regions) == 1:
        return stays
    in_article = any(line[1] and line[3] == 0 for line in lines)
    chars = [0] * len(regions)
    for text, article, _, region in lines:
        if article or not in_article:
            chars[region] += len(text)
    for i in range(len(regions) - 1, 0, -1):  # an inner region counts for the one around it as well
        kind, outer = regions[i][:2]
        if kind in ("form", "named"):
            chars[outer] += chars[i]
    for i, (kind, outer, articles, mains) in enumerate(regions):
        if i and stays[outer] and kind != "dropped":
            most = 2 * chars[i] > chars[0]
            stays[i] = mains > 0 or (kind in ("form", "named") and (
                (articles == 1 == regions[0][2] and not in_article) or (most and (kind == "form" or articles > 0 or chars[i] >= LEAST))))
    return stays


def page_lines(source: str) -> list[tuple[str, bool]]:
    """(line, protected) of the article's lines; protected lines stand in an article and aren't mostly links."""
    lines, inside = body_lines(source)
    return [(text, inside and not link) for text, link in lines]


def body_lines(source: str) -> tuple[list[tuple[str, bool]], bool]:
    """(line, whether it is mostly links) of all lines in articles if the page has any, else in the body; and if it has any.

    Elements end by their end tag, with the
    element around them, or where HTML lets the end tag be left out.
    """
    lines: list[tuple[str, bool, float, int]] = []
    parts: list[str] = []
    linked = 0  # characters of the open block inside links
    stack: list[tuple[str, int]] = []  # open elements, and the region around each
    regions: list[list] = [["", 0, 0, 0]]  # elements that may be left out: kind, outer region, articles and mains inside
    opened: dict[str, int] = {}
    region = article = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, article > 0, linked / len(text), region))
            parts.clear()
        linked = 0

    def close(keep: int) -> None:
        nonlocal region, article, links
        if keep < len(stack) and stack[keep][1] != region:
            flush()
        while len(stack) > keep:
            name, region = stack.pop()
            opened[name] -= 1
            article -= name in ("article", "main")
            links -= name == "a"

    def close_link() -> None:
        """An open link ends alone, without the blocks in it."""
        nonlocal links
        i = max(i for i, x in enumerate(stack) if x[0] == "a")
        if (stack[i + 1][1] if i + 1 < len(stack) else region) != stack[i][1] or not any(x in BLOCKS for x, _ in stack[i + 1:]):
            close(i)
        else:
            stack[i] = ("", stack[i][1])
            opened["a"] -= 1
            opened[""] = opened.get("", 0) + 1
            links -= 1

    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        end = m.start() if m else n
        if end > at and regions[region][0] != "dropped":
            parts.append(source[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in RAW:
            if not closing:
                at = _raw_end(source, name, at)
            continue
        if name in BLOCKS:
            flush()
        elif name in BREAKS:
            parts.append(" ")
        if name == "a" and links:
            close_link()
        if closing:
            close(_end(stack, opened, name))
            continue
        close(_implied_end(stack, opened, name))
        if name in VOID:
            continue
        kind = ""
        if regions[region][0] != "dropped" and name not in ("body", "html", "head"):
            kind = "dropped" if name in DROPPED else _named(attributes)
            if kind != "dropped":
                if name == "main":
                    kind = ""
                elif name in ASIDES or (name == "header" and not article):
                    kind = "aside"
                elif name == "form" and kind != "remark":
                    kind = "form"
        stack.append((name, region))
        opened[name] = opened.get(name, 0) + 1
        if kind:
            flush()
            regions.append([kind, region, 0, 0])
            region = len(regions) - 1
        if name in ("article", "main"):
            article += 1
            if kind != "remark":
                i = region
                while True:
                    regions[i][2 if name == "article" else 3] += 1
                    if i == 0:
                        break
                    i = regions[i][1]
        elif name == "a":
            links += 1
    flush()
    stays = _wanted(regions, lines)
    lines = [x for x in lines if stays[x[3]]]
    inside = any(x[1] for x in lines)
    return [(text, share > 0.5) for text, article, share, _ in lines if article or not inside], inside


def _raw_end(source: str, name: str, at: int) -> int:
    m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
    return m.end() if m else len(source)


def url_key(url: str | None) -> tuple[str | None, str | None]:
    """Host and path (its segments in order) of a URL, without query and fragment; nulls without a host."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)([^?#]*)", url or "")
    return (m[1].lower(), "/".join(s for s in m[2].split("/") if s)) if m else (None, None)


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b`` (Hunt and Szymanski)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(start, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(start, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            node = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(node)
            else:
                ends[k], chains[k] = j, node
    middle, node = [], chains[-1] if chains else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(start), *reversed(middle), *range(len(a) - tail, len(a))]


def _prefix(a: str, b: str) -> int:
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("uid", T.LongType()),
                           T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())),
                           T.StructField("weights", T.ArrayType(T.IntegerType())), T.StructField("inside", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                found = [body_lines(x.as_py() or "") for x in batch.column(2)]
                keys = [url_key(u) for u in batch.column(1).to_pylist()]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(range(uid, uid + n), pa.int64()), pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()), pa.array([[x for x, _ in p] for p, _ in found], pa.list_(pa.string())),
                    pa.array([[0 if link else len(x) for x, link in p] for p, _ in found], pa.list_(pa.int32())),
                    pa.array([x for _, x in found], pa.bool_())], names=schema.fieldNames())
                uid += n

    return map_arrow(pages.select(id_col, url_col, html_col), run, schema)


def _alike(a: dict, b: dict) -> bool:
    """Whether two pages are copies: they share at least 9/10 of the characters of their lines that aren't mostly links."""
    left: dict = {}
    for h, w in zip(a["hashes"], a["weights"]):
        left[h] = left.get(h, 0) + w
    shared = 0
    for h, w in zip(b["hashes"], b["weights"]):
        common = min(w, left.get(h, 0))
        left[h] = left.get(h, 0) - common
        shared += common
    return 20 * shared >= 9 * (sum(a["weights"]) + sum(b["weights"]))


def _shared_lines(parsed: DataFrame) -> DataFrame:
    """(uid, deleted): places of the lines that a page shares with its nearest page of other content, for pages that lose any.

    Pages are ranged by host and path segments, so that a large host is spread over many tasks. Pages in
    a row that are copies form a run; each page is compared with the last page before its run and
    the first after it. A run may go over several ranges: the driver carries the two pages at each edge
    of a range from range to range, four pages for each task. Only hashes and lengths of lines move.
    """
    parts = shuffle_partitions(parsed.sparkSession)
    order = ["host", "sort", "uid"]
    keys = parsed.where("host is not null and size(lines) > 0").select(
        "host", F.translate("path", "/", "\x01").alias("sort"), "path", "uid", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), "weights", "inside")
    schema = T.StructType([*keys.schema, T.StructField("range", T.IntegerType()), T.StructField("starts", T.BooleanType()), T.StructField("previous", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId(), None
        for batch in batches:
            starts, previous = [], []
            for page in batch.to_pylist():
                same = last is not None and last["host"] == page["host"]
                starts.append(last is not None and not (same and _alike(last, page)))
                previous.append(last["uid"] if same else None)
                last = page
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([number] * len(starts), pa.int32()), pa.array(starts, pa.bool_()), pa.array(previous, pa.int64())],
                                             names=schema.fieldNames())

    ranged = materialize(map_arrow(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order), mark, schema), "ranged")
    place = F.struct(*order)
    breaks = F.when(F.col("starts"), F.struct(*order, "previous"))
    edges = ranged.groupBy("range").agg(F.min(place)["uid"].alias("first"), F.max(place)["uid"].alias("last"), F.min(breaks).alias("early"), F.max(breaks).alias("late"))
    found = sorted(edges.collect(), key=lambda r: r["range"])  # one row for each task
    wanted = {u for r in found for u in (r["first"], r["last"], r["early"] and r["early"]["uid"], r["late"] and r["late"]["previous"]) if u is not None}
    at_edge = {r["uid"]: r.asDict() for r in ranged.where(F.col("uid").isin(list(wanted))).select("host", "path", "uid", "hashes", "weights", "inside").collect()} if wanted else {}

    def carried(rows: list, near: str, far: str, beyond: list) -> dict:
        """For each range the nearest page before it and the last one before that page's run, going through ``rows`` in order."""
        out, last, other = {}, None, None
        for r, own in zip(rows, beyond):
            out[r["range"]] = (last, other)
            if r["early"] is None:  # the range is within one run
                other = _outside(at_edge[r[near]], last, other)
            else:
                other = at_edge.get(own)
            last = at_edge[r[far]]
        return out

    before = carried(found, "first", "last", [r["late"] and r["late"]["previous"] for r in found])
    behind = found[::-1]
    after = carried(behind, "last", "first", [r["early"] and r["early"]["uid"] if r["early"] and r["early"]["previous"] is not None else None for r in behind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, list[int]]] = []
        rows = (page for batch in batches for page in batch.to_pylist())
        for number, pages in groupby(rows, key=lambda page: page["range"]):
            for page in _range_deletions(pages, *before[number], *after[number]):
                out.append(page)
                if len(out) == 500:
                    yield _deletions(out)
                    out = []
        yield _deletions(out)

    placed = ranged.repartition(parts, "range").sortWithinPartitions("range", *order)
    return map_arrow(placed, run, "uid long, deleted array<int>")


def _outside(page: dict, neighbour: dict | None, other: dict | None) -> dict | None:
    """The first page beyond the run of ``page``, if ``neighbour`` stands next to it and ``other`` beyond the neighbour's run."""
    if neighbour is None or neighbour["host"] != page["host"]:
        return None
    return other if _alike(neighbour, page) else neighbour


def _range_deletions(pages: Iterator[dict], last: dict | None, other: dict | None, following: dict | None, beyond: dict | None) -> Iterator[tuple[int, list[int]]]:
    """Deletions of a range's pages, given the pages before it (``last``, ``other``) and after it."""

    def ended(run: list[dict], before: dict | None, after: dict | None, copies: list[dict]) -> Iterator[tuple[int, list[int]]]:
        for i, page in enumerate(run):
            copy = run[i - 1] if i else run[i + 1] if i + 1 < len(run) else copies[0] if copies else None
            places = _deleted(page, before, after, copy)
            if places:
                yield page["uid"], places

    run: list[dict] = []
    before, copies = None, []
    for page in pages:
        if run and page["starts"]:
            same = page["host"] == run[-1]["host"]
            yield from ended(run, before, page if same else None, copies)
            before, copies, run = run[-1] if same else None, [], [page]
        else:
            if not run:
                before = _outside(page, last, other)
                copies = [last] if last and last["host"] == page["host"] and before is not last else []
            run.append(page)
    if run:
        after = _outside(run[-1], following, beyond)
        copies += [following] if following and following["host"] == run[-1]["host"] and after is not following else []
        yield from ended(run, before, after, copies)


def _deleted(page: dict, before: dict | None, after: dict | None, copy: dict | None) -> list[int]:
    """The lines that ``page`` shares with the one of its neighbours that has more leading path segments in common.

    In an article, lines that aren't mostly links are the template's only if they are at most half of
    the article. A copy shows nothing but which lines of links in an article come again.
    """
    near = [x for x in (before, after) if x is not None and not _alike(page, x)]
    if not near:
        return [i for i in common_lines(page["hashes"], copy["hashes"]) if not page["weights"][i]] if copy and page["inside"] else []
    places = common_lines(page["hashes"], max(near, key=lambda x: _prefix(x["path"], page["path"]))["hashes"])
    if page["inside"] and 2 * sum(page["weights"][i] for i in places) > sum(page["weights"]):
        return [i for i in places if not page["weights"][i]]
    return places


def _deletions(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["uid", "deleted"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (blocks joined by an empty line) and ``n_chars`` (code points).

    Null or empty html gives an empty text. A null URL, or one without a host, has no nearest page:
    such a page loses only what its markup names. Ties in nearness go to the page before; repeated
    rows are pages like any others. Character references are decoded, white space inside a block is
    one space. Other columns are not read.
    """
    parsed = materialize(_parsed(pages, id_col, url_col, html_col), "pages")
    deleted = materialize(_shared_lines(parsed), "deletions")  # only pages that lose lines: joined small or by uid
    out = parsed.select("id", "url", "uid", "lines").join(deleted, "uid", "left")
    kept = F.when(F.col("deleted").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.array_contains(F.col("deleted"), i)))
    text = F.array_join(kept, "\n\n")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
