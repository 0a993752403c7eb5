"""Main text of web pages by page differencing between neighbours in URL order, and markup.

Each page becomes lines (one for each block of its markup) with the zone they stand in.  Pages of a
host are sorted by URL path; each is aligned with its neighbours by a longest common subsequence of
lines, and lines shared with a neighbour are template and deleted.  Two neighbours that share most
of their text, and most of their articles, are copies of one article, whose common lines tell nothing, so
they are not differenced.  The articles are compared by the lines in an article or main element if both
have one, else by the squared lengths of all lines, as template lines are short and many.
Markup is the check on it: a line inside an article or main element is given back if only one neighbour
has it too, as two articles may share a sentence; one that both neighbours have is template there as
well.  Lines outside such an element are printed as differencing leaves them.  Lines in elements that
markup names as menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles
go in any case.  A class names such an element only by a whole token of such words.  One inside a line of
text takes its own text out and leaves the line whole.

Lines that repeat in a page are told apart by their occurrence, so the alignment is a longest
increasing subsequence, O(n log n) at any length.  Pages are dealt by ranges of (host, path, page_id), so
no task holds a large host; the first and last page of a range then meet their neighbours in the next
ranges, so a page's neighbours are the nearest in URL order wherever the cuts lie.

Null html: empty.  Null URL: a host of its own, in order of page_id.  Repeated rows are pages of their
own; rows of one page_id and URL are in order of their html's hash.  A page of any length is read whole.
Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import materialize, slices, table

#: Keys from which the cuts of one range are chosen, about; they decide the balance only, never a result.
KEYS_PER_RANGE = 64
#: Pages that a range has, about, unless that would be more ranges than the cuts may take memory for.
RANGE_PAGES, MOST_RANGES = 512, 100_000
#: Neighbours that share more than this of the shorter page's free text, and of its article, are copies of one article.
COPY_SHARE = 0.6

NAME = re.compile(r"[a-zA-Z][\w:-]*")
#: What ends a tag or begins a quoted value in it.
SPECIAL = re.compile("[>\"']")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "math"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
MARK = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STORY = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody")
WORD = re.compile(r"[a-z]+")
#: Words in class, id or role that name page furniture, if the token has no words but these and neutral ones.
FURNITURE = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related recommended recommendations replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo".split())
HEADERS = {"header", "hero", "topbar"}
NEUTRAL = set("area articles bar block body bottom box btn button buttons center column container content div form group holder icon icons inner item items js left links list main message middle module outer page panel post posts row right section site slot small sticky stories text title top unit user wrap wrapper x".split())
#: A paragraph or list item ends where one of these begins or where its parent ends.
IMPLIED = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}


def furniture(name: str, attrs: str, in_main: bool) -> bool:
    if name in DROP or name == "header" and not in_main:
        return True
    if not attrs:
        return False
    if "=" not in attrs or name in ("html", "body"):
        return bool(re.search(r"\bhidden\b", attrs)) if name not in ("html", "body") else False
    for m in MARK.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").split():
            # a token with a word of its own names a thing of the story: related-work, menu-recipe
            words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
            named = words & FURNITURE or words & HEADERS and not in_main
            if named and words <= FURNITURE | HEADERS | NEUTRAL:
                return name not in MAIN
    return False


class Scanner:
    """Tags and texts of a page, one pass: a tag's end is sought once from each special character."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.ends: dict[int, int] = {}
        self.span = (0, -1)
        self.missing: set[str] = set()

    def _find(self, what: str, at: int) -> int:
        """Once there is none, there is none further on."""
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def _tag_end(self, at: int) -> int:
        """Behind the > that ends a tag, quoted values skipped; -1 if the page ends before."""
        path, out = [], -1
        while True:
            # no special character lies between the last start and where it led
            if not self.span[0] <= at <= self.span[1]:
                m = SPECIAL.search(self.page, at)
                self.span = (at, m.start() if m else len(self.page))
            k = self.span[1]
            if k == len(self.page):
                break
            if k in self.ends:
                out = self.ends[k]
                break
            path.append(k)
            if self.page[k] == ">":
                out = k + 1
                break
            at = self.page.find(self.page[k], k + 1) + 1
            if not at:
                break
        for k in path:
            self.ends[k] = out
        return out

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """("", "", text), (name, "/" or "", attributes); comments, declarations and raw elements are left out."""
        page, at, text = self.page, 0, 0
        while True:
            k = page.find("<", at)
            if k < 0:
                break
            second, end = page[k + 1 : k + 2], -1
            if second == "!" or second == "?":
                if page.startswith("<!--", k):
                    end = self._find("-->", k + 4) + 3
                    end = len(page) if end == 2 else end
                elif not page.startswith("<![CDATA[", k) or (end := self._find("]]>", k + 9) + 3) == 2:
                    end = self._find(">", k + 2) + 1 or -1
                if end < 0:
                    at = k + 1
                    continue
                if text < k:
                    yield "", "", page[text:k]
                at = text = end
                continue
            closing = second == "/"
            m = NAME.match(page, k + 1 + closing)
            end = self._tag_end(m.end()) if m else -1
            if end < 0:
                at = k + 1
                continue
            if text < k:
                yield "", "", page[text:k]
            at = text = end
            name, attrs = m[0].lower(), page[m.end() : end - 1]
            if name in RAW and not closing:
                if not attrs.endswith("/"):
                    found = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name not in self.missing else None
                    if not found:
                        self.missing.add(name)
                    at = text = found.end() if found else len(page)
                continue
            yield name, "/" if closing else "", attrs
        if text < len(page):
            yield "", "", page[text:]


class Open:
    """Open elements, with counts of those that hide or mark text, so that no tag looks through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, furniture, main
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.aside = self.main = self.hidden = 0

    @property
    def zone(self) -> int:
        return 0 if self.aside else 2 if self.main else 1

    def push(self, name: str, out: bool, main: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, out, main))
        self._count(name, out, main, 1)

    def pop(self) -> None:
        name, out, main = self.stack.pop()
        self.places[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        self._count(name, out, main, -1)

    def _count(self, name: str, out: bool, main: bool, by: int) -> None:
        # furniture in a line of text hides its own text and leaves the line whole
        self.aside += by * (out and name in BLOCK)
        self.hidden += by * (out and name not in BLOCK)
        self.main += by * main

    def closed_by(self, name: str) -> int | None:
        """The place of the element that a closing tag ends; one in a line of text ends nothing outside its block."""
        own = self.places.get(name)
        if not own or name not in BLOCK and self.blocks and self.blocks[-1] > own[-1]:
            return None
        return own[-1]

    def ended_by(self, name: str) -> int | None:
        """The place of an element that the beginning of a block ends: a paragraph, an item beside it, open marks of text."""
        if self.blocks:
            last = self.stack[self.blocks[-1]][0]
            if last == "p" or last == name and name in IMPLIED:
                return self.blocks[-1]
        if self.stack and self.stack[-1][0] not in BLOCK and not self.stack[-1][1]:
            return len(self.stack) - 1
        return None


def lines_of(page: str) -> list[tuple[str, int]]:
    """Lines of a page with zone: 2 in an article or main element, 1 elsewhere, 0 furniture; so many neighbours delete a line."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    now = Open()

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, now.zone))

    def close(place: int) -> None:
        if (now.aside or now.main) and any(x[2] or x[1] and x[0] in BLOCK for x in now.stack[place:]):
            # the zone may change
            flush()
        while len(now.stack) > place:
            now.pop()

    for name, closing, attrs in Scanner(page).parts():
        if not name:
            if not now.hidden:
                buffer.append(attrs)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        if closing:
            place = now.closed_by(name)
            if place is not None:
                close(place)
        elif name not in VOID and not attrs.endswith("/"):
            if block and name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "ul", "ol", "dl") or name in IMPLIED:
                while (place := now.ended_by(name)) is not None:
                    close(place)
            main = name in MAIN or bool(attrs and STORY.search(attrs))
            if main and not block:
                flush()
            now.push(name, furniture(name, attrs, now.zone == 2), main)
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b."""

    def named(x: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for h in x:
            seen[h] = seen.get(h, -1) + 1
            out.append((h, seen[h]))
        return out

    where = {k: j for j, k in enumerate(named(b))}
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = [-1] * len(a)
    for i, k in enumerate(named(a)):
        j = where.get(k)
        if j is None:
            continue
        p = bisect_left(tails, j)
        before[i] = last[p - 1] if p else -1
        tails[p : p + 1] = [j]
        last[p : p + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def address(url: str | None) -> tuple[str, str]:
    """Host and path; scheme, query and fragment don't count."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), re.sub(r"\.html?$", "", path.rstrip("/"))


class _Page:
    """Lines of a page, their zones, and by how many neighbours each is shared."""

    def __init__(self, page_id, url, host, texts, zones, times=None) -> None:
        self.page_id, self.url, self.host, self.texts, self.zones = page_id, url, host, texts, zones
        self.hashes = [xxhash.xxh64_intdigest(t) for t in texts]
        self.times = list(times) if times is not None else [0] * len(texts)

    def meet(self, other: _Page | None) -> None:
        """Count the lines shared with a neighbour of the same host, unless both are copies of one article."""
        if other is None or other.host != self.host:
            return
        shared = shared_lines(self.hashes, other.hashes)
        if not self.copies(other, shared):
            for k in shared:
                self.times[k] += 1

    def copies(self, other: _Page, shared: list[int]) -> bool:
        """Whether most free text is shared, and most of the articles too: by markup or, without it, by the longest lines."""

        def most(zone: int, power: int) -> bool:
            common = sum(len(self.texts[k]) ** power for k in shared if self.zones[k] >= zone)
            return common > COPY_SHARE * min(sum(len(t) ** power for t, z in zip(p.texts, p.zones, strict=True) if z >= zone) for p in (self, other))

        return most(1, 1) and (most(2, 1) if 2 in self.zones and 2 in other.zones else most(1, 2))

    def main(self) -> str:
        return "\n".join(t for t, z, n in zip(self.texts, self.zones, self.times, strict=True) if z and n < z)


def _pack(texts: list[str]) -> bytes:
    # a line holds no line break
    return zlib.compress("\n".join(texts).encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list[str]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _parse(cuts: list[tuple]):
    """page_id, url, host, path, part (the range), tie, lines, zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 128):
                host, path, part, tie, texts, zones = [], [], [], [], [], []
                for i, url, page in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                    h, p = address(url)
                    html = page.as_py() or ""
                    found = lines_of(html)
                    host.append(h)
                    path.append(p)
                    part.append(bisect_left(cuts, _order(h, p, i)))
                    tie.append(xxhash.xxh64_intdigest(html) - (1 << 63))
                    texts.append(_pack([t for t, _ in found]))
                    zones.append(bytes(z for _, z in found))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(host), pa.array(path), pa.array(part, pa.int32()), pa.array(tie, pa.int64()), pa.array(texts, pa.binary()), pa.array(zones, pa.binary())], ["page_id", "url", "host", "path", "part", "tie", "lines", "zones"])

    return run


def _order(host: str, path: str, page_id: int | None) -> tuple:
    return host, path, -(1 << 63) if page_id is None else page_id


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [address(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["page_id", "host", "path"])


def range_cuts(pages: DataFrame, ranges: int) -> list[tuple]:
    """Upper ends of all ranges but the last, from a bounded number of keys; reads ids and URLs only."""
    n = pages.count()
    if ranges < 2 or not n:
        return []
    every = max(1, n // (ranges * KEYS_PER_RANGE))
    keys = pages.select(F.col("page_id").cast("long"), "url").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0)
    found = sorted(_order(r.host, r.path, r.page_id) for r in keys.mapInArrow(_keys, "page_id long, host string, path string").orderBy(F.xxhash64("host", "path", "page_id")).limit(4 * ranges * KEYS_PER_RANGE).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


OUT = "page_id long, url string, text string, n_chars long"
EDGE = "part int, at int, host string, lines binary, zones binary, times binary"
#: Of a range: its only page, its first one, its last one.
ONLY, FIRST, LAST = 0, 1, 2


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and key: texts of inner pages, and the edge pages of each range with what they know so far."""
    rows: list[tuple] = []
    before: _Page | None = None
    part, first = None, True

    def edge(page: _Page, at: int) -> tuple:
        return page.page_id, page.url, None, None, part, at, page.host, _pack(page.texts), page.zones, bytes(page.times)

    def inner(page: _Page) -> tuple:
        text = page.main()
        return page.page_id, page.url, text, len(text), None, None, None, None, None, None

    for batch in batches:
        for some in slices(batch, 128):
            for r in some.to_pylist():
                page = _Page(r["page_id"], r["url"], r["host"], _unpack(r["lines"]), r["zones"])
                if before is not None and part != r["part"]:
                    rows.append(edge(before, ONLY if first else LAST))
                    before, first = None, True
                if before is not None:
                    before.meet(page)
                    page.meet(before)
                    rows.append(edge(before, FIRST) if first else inner(before))
                    first = False
                before, part = page, r["part"]
            if rows:
                yield _batch(rows)
                rows = []
    if before is not None:
        yield _batch([edge(before, ONLY if first else LAST)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    names = ["page_id", "url", "text", "n_chars", "part", "at", "host", "lines", "zones", "times"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and side: the last page of the range before (0), the range's own edges (1), the first page after (2)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    key, own, near = None, [], {}

    def finish() -> Iterator[pa.RecordBatch]:
        out = []
        for page, at in own:
            if at in (ONLY, FIRST):
                page.meet(near.get(0))
            if at in (ONLY, LAST):
                page.meet(near.get(2))
            text = page.main()
            out.append({"page_id": page.page_id, "url": page.url, "text": text, "n_chars": len(text)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                yield from finish()
                key, own, near = r["key"], [], {}
            page = _Page(r["page_id"], r["url"], r["host"], _unpack(r["lines"]), r["zones"], r["times"])
            if r["side"] == 1:
                own.append((page, r["at"]))
            else:
                near[r["side"]] = page
    yield from finish()


def extract_text(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row; ranges: how many parts the pages are dealt into."""
    spark = pages.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, pages.count() // RANGE_PAGES))
    cuts = range_cuts(pages, ranges)
    lines = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parse(cuts), "page_id long, url string, host string, path string, part int, tie long, lines binary, zones binary")
    rows = lines.repartition(max(n_parts, ranges // 2), "part").sortWithinPartitions("part", "host", "path", "page_id", "tie")
    done = materialize(rows.select("page_id", "url", "host", "part", "lines", "zones").mapInArrow(_difference, f"{OUT}, {EDGE}"), "zstd")
    edges = done.where("part is not null")
    # one number for each range
    parts = sorted(r.part for r in edges.select("part").distinct().collect())
    steps = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "earlier int, later int")
    after = edges.where(F.col("at") != LAST).join(F.broadcast(steps), F.col("part") == F.col("later")).select(F.col("earlier").alias("key"), F.lit(2).alias("side"), "*")
    before = edges.where(F.col("at") != FIRST).join(F.broadcast(steps), F.col("part") == F.col("earlier")).select(F.col("later").alias("key"), F.lit(0).alias("side"), "*")
    names = ["key", "side", "at", "page_id", "url", "host", "lines", "zones", "times"]
    all_ = edges.select(F.col("part").alias("key"), F.lit(1).alias("side"), "*").select(*names).union(after.select(*names)).union(before.select(*names))
    met = all_.repartition(n_parts, "key").sortWithinPartitions("key", "side", "at").mapInArrow(_join_edges, OUT)
    return done.where("part is null").select("page_id", "url", "text", "n_chars").union(met)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
