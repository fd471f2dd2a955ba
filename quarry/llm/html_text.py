"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines: one per block element, in page order, with character
references decoded and white space collapsed.  Pages are range-partitioned and
sorted by (host, URL path), so that a host of any size spreads over many tasks,
and each page is paired with its neighbours in that order on the same host.
Each partition hands the pages at its two edges on, one row per edge; pages that
look beyond an edge join the row of the partition there.  A row that cannot
answer (an empty partition, or a run of copies) takes over the next one's first,
over twice the distance each round.  An edge hands on a few pages; the hosts of
pages that are copies of all of those are done again with edges that hand on
more, until no page is left undecided.  Pages are moved compressed, and finished
texts are kept in compressed blocks until the edges are known.  The lines of a
pair are aligned by their longest common subsequence, and lines shared with a
neighbour are template: they are deleted - unless they lie inside an explicit
article or main element, whose own repeated sentences belong to the text.
Lines of elements that are never main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) go in any case.  A
neighbour that shares ``COPY_SHARE`` of the text of the smaller page is a copy or
near copy and says nothing about the template; the nearest page of the host that
is none is taken instead, where a copy's copies count as copies.  A line counts
by its length to the power 1.5, so paragraphs tell a copy and menus do not.

Null or empty pages give an empty text; pages without a URL form a host of
their own, in which nothing is paired; unclosed tags and cut-off references are
taken as browsers do; repeated rows give repeated results; extra columns are
ignored; pages of any length are used whole.
"""

from __future__ import annotations

import bz2
import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import buckets_for, cut, read, text_bytes

PARTITION_BYTES = 2 << 20
BLOCK_CHARS = 800_000  # text of finished pages that is compressed at once
COPY_SHARE = 0.8
EDGE_PAGES = 4  # pages an edge hands on at first: its outermost page, the nearest that is no copy of it, and so on
MORE_PAGES = 8  # times as many for the hosts with a page that is a copy of all of them
# Names of HTML elements and of common page parts.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "noembed", "noframes", "xmp"}
NEVER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "mark",
          "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PARTS = re.compile(r"(^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|cookies?|consent|"
                   r"notice|popup|modal|newsletter|subscribe|signup|comments?|replies|respond|disqus|social|share|sharing|related|recommended|widget)([\s_-]|$)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<[!?][^>]*(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"[\s ]+")


def _never(tag: str, attributes: str, main: bool) -> bool:
    if tag in NEVER:
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                return True
            if name in ("class", "id") and PARTS.search(value):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, str]]:
    """(kind, line) of each block: kind is "main", "other" or "never"."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside a never part, inside article or main

    def flush():
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                never, main = stack[-1][1:] if stack else (False, False)
                out.append(("never" if never else "main" if main else "other", line))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t not in INLINE for t, _, _ in stack[k:]) or stack[-1][1] != (stack[k - 1][1] if k else False):
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m.group(3).endswith("/"):
            continue
        never, main = stack[-1][1:] if stack else (False, False)
        gone = never or _never(tag, m.group(3), main)
        if tag in INLINE and gone != never:
            flush()
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        stack.append((tag, gone, main or tag in ("article", "main")))
    flush()
    return out


def common_lines(one: list[str], two: list[str]) -> set[int]:
    """Places in ``one`` that lie on a longest common subsequence with ``two`` (bit-parallel rows, divided in halves)."""
    shared: set[int] = set()

    def row_of(a: list[str], b: list[str]) -> list[int]:
        """Length of the common subsequence of ``a`` with every prefix of ``b``."""
        places: dict[str, int] = {}
        for j, x in enumerate(b):
            places[x] = places.get(x, 0) | 1 << j
        full = (1 << len(b)) - 1
        v = full
        for x in a:
            u = v & places.get(x, 0)
            v = ((v + u) | (v - u)) & full
        out = [0]
        for j in range(len(b)):
            out.append(out[-1] + (not v >> j & 1))
        return out

    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            shared.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            shared.add(b - 1)
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        if b - a == 1:
            if one[a] in two[c:d]:
                shared.add(a)
            continue
        mid = (a + b) // 2
        left = row_of(one[a:mid], two[c:d])
        right = row_of(one[mid:b][::-1], two[c:d][::-1])[::-1]
        k = max(range(d - c + 1), key=lambda j: left[j] + right[j])
        todo += [(a, mid, c, c + k), (mid, b, c + k, d)]
    return shared


Lines = list[tuple[str, str]]


def weight(lines: Lines) -> float:
    return sum(len(x) ** 1.5 for kind, x in lines if kind != "never")


def template_of(lines: Lines, other: Lines) -> set[int] | None:
    """Places of the lines shared with another page; None if that page is a copy or near copy."""
    if lines == other:
        return None
    shared = common_lines([x for _, x in lines], [x for _, x in other])
    common = weight([lines[k] for k in sorted(shared)])
    return shared if common < COPY_SHARE * min(weight(lines), weight(other)) else None


def main_text(lines: Lines, template: set[int]) -> str:
    """Lines that are left after differencing, two line ends between them."""
    return "\n\n".join(x for k, (kind, x) in enumerate(lines) if kind == "main" or kind == "other" and k not in template)


def nearest(lines: Lines, others: list[Lines]) -> tuple[int, set[int]] | None:
    """Place of the first page that is no copy, and the lines shared with it."""
    for k, other in enumerate(others):
        shared = template_of(lines, other)
        if shared is not None:
            return k, shared
    return None


def difference(pages: list[Lines], host: list[str]) -> tuple[list[int], list[set[int]]]:
    """For each page in order the nearest page before it on its host that is no copy (-1: none), and the lines shared with it."""
    before: list[int] = []
    template: list[set[int]] = []
    for i, lines in enumerate(pages):
        at, shared = i - 1 if i and host[i] == host[i - 1] != "" else -1, None
        while at >= 0 and (shared := template_of(lines, pages[at])) is None:
            at = before[at]
        before.append(at)
        template.append(shared or set())
    return before, template


def pack(value) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 1)


def unpack(data: bytes | None):
    return json.loads(zlib.decompress(data)) if data is not None else None


def _edge(pages: list[Lines], host: list[str], before: list[int], most: int) -> tuple[str | None, list[Lines], bool, bool]:
    """Host and pages that the last page's side hands on, whether pages further on may belong to them, and whether more were left out."""
    if not pages:
        return None, [], True, False
    chain, at = [], len(pages) - 1
    while at >= 0 and len(chain) < most:
        chain.append(pages[at])
        at = before[at]
    beyond = host[0] == host[-1] != ""
    return host[-1], chain, len(chain) < most and beyond, len(chain) == most and (at >= 0 or beyond)


def _widen(table: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """Open edges, prolonged by the edges further on."""
    out = []
    for r in table.to_pylist():
        if r["open"]:
            pages, far = unpack(r["pages"]), unpack(r["far_pages"])
            if far is None:
                r["open"] = False
            elif r["host"] is None:
                r |= {"host": r["far_host"], "pages": r["far_pages"], "open": r["far_open"], "more": r["far_more"]}
            elif r["far_host"] is None:
                r["open"] = r["far_open"]
            elif r["host"] != r["far_host"]:
                r["open"] = False
            else:
                found = nearest(pages[-1], far)
                pages += far[found[0]:] if found else []
                full = len(pages) >= most
                r |= {"pages": pack(pages[:most]), "open": r["far_open"] and not full, "more": r["far_more"] or len(pages) > most or full and r["far_open"]}
        out.append({c: r[c] for c in EDGES.names})
    return pa.RecordBatch.from_pylist(out, EDGES)


EDGES = pa.schema([("side", pa.string()), ("at", pa.int64()), ("host", pa.string()), ("pages", pa.binary()), ("open", pa.bool_()), ("more", pa.bool_())])
EDGE_KIND = "side string, at long, host string, pages binary, open boolean, more boolean"


def _resolved(edges: DataFrame, most: int) -> DataFrame:
    """Edge rows of which none waits for pages further on."""
    step = 1
    edges = cut(edges)
    while edges.where("open").limit(1).count():
        far = edges.select("side", (F.col("at") + step).alias("at"), F.col("host").alias("far_host"), F.col("pages").alias("far_pages"),
                           F.col("open").alias("far_open"), F.col("more").alias("far_more"))
        edges = cut(edges.join(far, ["side", "at"], "left").mapInArrow(lambda batches: (_widen(b, most) for b in batches), EDGE_KIND))
        step *= 2
    return edges


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    kind = pages.schema[id_column].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.col(url_column), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(F.col(url_column), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    d = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"),
                     F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    out = _texts(d.withColumn("tie", F.xxhash64("html")), kind, EDGE_PAGES).select("page_id", "url", "text", "n_chars")
    return out.withColumnsRenamed({"page_id": id_column, "url": url_column})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with compressed pages."""
    for batch in batches:
        pages = pa.array([zlib.compress(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pages, *batch.columns[3:]], batch.schema.names)


def _texts(d: DataFrame, kind: str, most: int) -> DataFrame:
    """page_id, url, text, n_chars, host of pages (page_id, url, html, host, path, tie), with edges of ``most`` pages at first."""
    whole, order = d, ["host", "path", "page_id", "tie"]
    packed = d.mapInArrow(_packed, f"page_id {kind}, url string, html binary, host string, path string, tie long")
    d = packed.repartitionByRange(buckets_for(text_bytes(d, "html"), PARTITION_BYTES, least=1), *order).sortWithinPartitions(*order)
    ids = pa.from_numpy_dtype({"bigint": "int64", "int": "int32"}.get(kind, "int64")) if kind != "string" else pa.string()
    rows = pa.schema([("page_id", ids), ("url", pa.string()), ("texts", pa.binary()), ("left", pa.int64()), ("right", pa.int64()),
                      ("template", pa.binary()), *EDGES])
    done_rows = pa.schema([("page_id", ids), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("host", pa.string()), ("undecided", pa.bool_())])
    done_kind = f"page_id {kind}, url string, text string, n_chars long, host string, undecided boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of finished pages; pages that look beyond an edge with their lines; then the two edges of the partition."""
        part = TaskContext.get().partitionId()
        names, host, lines = [], [], []
        for batch in batches:
            for i, u, page, h in zip(*(batch.column(k).to_pylist() for k in range(4))):
                names.append((i, u))
                host.append(h)
                lines.append(lines_of(zlib.decompress(page).decode("utf-8", "surrogatepass")))
                if len(lines) > 1 and lines[-1] == lines[-2]:
                    lines[-1] = lines[-2]
        before, one = difference(lines, host)
        after, two = difference(lines[::-1], host[::-1])
        held, size, finished, length = [], 0, [], 0

        def block() -> dict:
            table = pa.RecordBatch.from_pylist(finished, done_rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, done_rows) as writer:
                writer.write_batch(table)
            finished.clear()
            return {"texts": bz2.compress(sink.getvalue())}

        for i, (name, url) in enumerate(names):
            j = len(names) - 1 - i
            template = one[i] | two[j]
            left, right = (at < 0 and host[i] == host[end] != "" for at, end in ((before[i], 0), (after[j], -1)))
            if not left and not right:
                text = main_text(lines[i], template)
                finished.append({"page_id": name, "url": url, "text": text, "n_chars": len(text), "host": host[i], "undecided": False})
                length += len(text)
                if length > BLOCK_CHARS:
                    held.append(block())
                    size, length = size + len(held[-1]["texts"]), 0
            else:
                # places that no edge has where a side needs none
                held.append({"page_id": name, "url": url, "host": host[i], "left": part - 1 if left else -2 - part, "right": -part - 1 if right else 1 + part,
                             "pages": pack(lines[i]), "template": pack(sorted(template))})
                size += len(held[-1]["pages"])
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, rows)
                held, size = [], 0
        if finished:
            held.append(block())
        for side, at, edge in (("left", part, _edge(lines, host, before, most)), ("right", -part, _edge(lines[::-1], host[::-1], after, most))):
            held.append({"side": side, "at": at, "host": edge[0], "pages": pack(edge[1]), "open": edge[2], "more": edge[3]})
        yield pa.RecordBatch.from_pylist(held, rows)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of the blocks."""
        for batch in batches:
            for data in batch.column(0):
                yield from pa.ipc.open_stream(bz2.decompress(data.as_py()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, 256) for batch in batches for a in range(0, batch.num_rows, 256)):
            out = []
            for r in part.to_pylist():
                undecided = False
                lines, template = unpack(r["pages"]), set(unpack(r["template"]))
                for side in ("left", "right"):
                    if r[f"{side}_host"] == r["host"]:
                        found = nearest(lines, unpack(r[f"{side}_pages"]))
                        template |= found[1] if found else set()
                        undecided |= found is None and r[f"{side}_more"]
                text = main_text(lines, template)
                out.append({"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text), "host": r["host"], "undecided": undecided})
            yield pa.RecordBatch.from_pylist(out, done_rows)

    done = cut(d.drop("path", "tie").mapInArrow(run, f"page_id {kind}, url string, texts binary, left long, right long, template binary, {EDGE_KIND}"))
    edges = _resolved(done.where("side is not null").select(*EDGES.names), most)
    texts = done.where("texts is not null").select("texts")
    open_ = done.where("side is null and texts is null").select("page_id", "url", "left", "right", "template", "host", "pages")
    for side in ("left", "right"):
        open_ = open_.join(edges.where(F.col("side") == side).select(F.col("at").alias(side), F.col("host").alias(f"{side}_host"),
                                                                     F.col("pages").alias(f"{side}_pages"), F.col("more").alias(f"{side}_more")), side, "left")
    last = cut(open_.mapInArrow(finish, done_kind))
    out = texts.mapInArrow(opened, done_kind).unionByName(last)
    late = last.where("undecided").select("host").distinct()
    if late.limit(1).count():
        again = _texts(whole.join(late, "host", "left_semi").select(*whole.columns), kind, most * MORE_PAGES)
        return out.drop("undecided").join(late, "host", "left_anti").select(*again.columns).unionByName(again)
    return out.drop("undecided")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
