"""Main text of HTML pages by nearest-URL page differencing.

Each page becomes a list of text lines, one for each block, in page order. Lines inside menus, headers, footers, side columns,
notices, adverts, forms, comments, scripts, styles and hidden parts are marked as chrome by element and by class, id and role
words. Pages are ordered by host and URL path over ranges, so a host with a third of all pages spreads over many tasks; each
page is paired with the neighbour on its host whose path has the longer common beginning, their lines are aligned by longest
common subsequence, and shared lines are deleted. The up to WINDOW pages on either side on the same host say what a shared line
is: boilerplate lies on several pages, a mirrored or quoted text on one. Copies with equal lines are no neighbours.

* Shared lines of at most half of the text are deleted. In an article or main element, lines of long prose stay, and a short one
  goes only if a further page, where there is one, has it too.
* Shared lines of more than half of the text are deleted where two further pages (or the only one) have them too; the rest is a
  mirror. Without a further page a page with an article is a mirror; one without keeps its lines if nothing else would be left.

Each range also gets the WINDOW pages before and after it, so that the result does not depend on where ranges are cut.

Null html is an empty page: empty text. A null or odd URL has an empty host and pairs with its like. Repeated rows give repeated
results. Very long pages are read whole; the alignment first drops equal ends and lines that only one side has. Other columns
are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|</?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?(?P<odd>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>?",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed element names and words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math select option button object canvas audio video".split())
CHROME = set("nav header footer aside form menu dialog head".split())
CONTAINER = set("html body div section article main ul ol dl table tbody thead tfoot tr td th figure details fieldset center".split()) | CHROME
BLOCK = CONTAINER | set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre br hr address figcaption summary caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe "
    "signup login comment comments commentlist disqus reply replies discussion responses share sharing social related recommended teaser pagination pager toolbar search".split()
)
WINDOW = 3
PROSE = 100  # characters of a line that counts as long prose if it has the end of a sentence
SENTENCE = re.compile(r"[.!?\u2026](?=\W|\Z)|[\u3002\uff01\uff1f]")
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def _is_chrome(name: str, attributes: dict[str, str]) -> bool:
    if name in CHROME:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower())
    return name not in ("html", "body", "article", "main") and any(w in CHROME_WORDS for w in words)


def lines_of(source: str | None) -> list[tuple[str, bool]]:
    """(text, core) of each block outside the chrome, in page order; core: inside an article or main element."""
    source = source or ""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, chrome, core
    chrome = core = 0
    buffer: list[str] = []
    heading = False  # a heading of the article's own header is text

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, core > 0))

    at = 0
    for m in iter(lambda: TOKEN.search(source, at), None):
        if m.start() > at and (not chrome or heading):
            buffer.append(source[at : m.start()])
        at = m.end()
        name = (m["name"] or m["odd"] or "").lower()
        if not name:
            continue
        closing = source.startswith("</", m.start())
        if name in BLOCK:
            flush()
        if closing:
            if name in HEADINGS:
                heading = False
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    for _, c, k in stack[depth:]:
                        chrome -= c
                        core -= k
                    del stack[depth:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else (len(source) if name in ("script", "style", "title", "textarea") else at)
            continue
        if name in VOID:
            continue
        attributes = _attributes(m["attributes"] or m["rest"] or "")
        if name in ("article", "main") or attributes.get("role") == "main":
            while stack and stack[-1][1] and stack[-1][0] in ("div", "section", "ul", "head"):  # left open by mistake
                chrome -= 1
                core -= stack.pop()[2]
        is_chrome = _is_chrome(name, attributes)
        if name in HEADINGS and chrome == 1 and core and any(s[0] == "header" and s[1] for s in stack) and not is_chrome:
            heading = True
        if name in CONTAINER or is_chrome:
            is_core = name in ("article", "main") or attributes.get("role") == "main"
            stack.append((name, is_chrome, is_core))
            chrome += is_chrome
            core += is_core
    if not chrome:
        buffer.append(source[at:])
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of a in a longest common subsequence of a and b."""
    out, start = set(), 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        out.add(start)
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        out.add(len(a) - 1 - end)
        end += 1
    in_b, in_a = set(b[start : len(b) - end]), set(a[start : len(a) - end])
    left = [i for i in range(start, len(a) - end) if a[i] in in_b]
    right = [j for j in range(start, len(b) - end) if b[j] in in_a]
    places: dict[str, list[int]] = {}
    for j in right:
        places.setdefault(b[j], []).append(j)
    # Hunt-Szymanski: an increasing chain of matches, patience style
    tops: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in left:
        for j in reversed(places[a[i]]):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(own: list[tuple[str, bool]], other: list[tuple[str, bool]] | None, further: Iterable[list[tuple[str, bool]]] = ()) -> list[str]:
    """Lines of the main text, given the lines of the page's neighbour (None: it has none) and of further pages of its host."""
    has_core = any(core for _, core in own)
    lines = [text for text, core in own if core or not has_core]
    pages = [[text for text, _ in page] for page in (other, *further) if page is not None and page != own]
    if not lines or not pages:
        return lines
    shared = shared_lines(lines, pages[0])
    held = [set(page) for page in pages[1:]] if shared else []
    on = {i: sum(lines[i] in page for page in held) for i in shared}
    if 2 * sum(len(lines[i]) for i in shared) > sum(map(len, lines)):
        if held:
            shared = {i for i in shared if on[i] >= min(2, len(held))}
        elif has_core or len(shared) == len(lines):
            return lines
    if has_core:
        shared = {i for i in shared if on[i] >= min(1, len(held)) and not _is_prose(lines[i])}
    return [text for i, text in enumerate(lines) if i not in shared]


def _is_prose(line: str) -> bool:
    return len(line) >= PROSE and SENTENCE.search(line) is not None


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path with query of a URL; empty where it cannot be read."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").removeprefix("www."), f"{parts.path}?{parts.query}"
    except ValueError:
        return "", ""


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """Last places of all ranges but one, from a sample of a bounded number of places."""
    share = min(1.0, 100 * ranges / max(1, keys.count()))
    sample = sorted((r["host"], r["path"], r["tie"]) for r in keys.sample(share, seed=4).limit(400 * ranges).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _outside(keys: DataFrame, cuts: list[tuple[str, str, int]]) -> dict[tuple[str, str, int], set[int]]:
    """Places of the WINDOW pages before and after each range that are on the host of its first and last page, with the ranges."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = [], deque(maxlen=WINDOW)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if len(first) < WINDOW:
                    first.append(tuple(row))
                last.append(tuple(row))
        rows = first + [r for r in last if r not in first]
        yield pd.DataFrame(rows, columns=["host", "path", "tie", "range"])

    schema = "host string, path string, tie bigint, range int"
    numbered = keys.mapInPandas(_number(cuts), schema).repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("host", "path", "tie")
    found = sorted(((r["host"], r["path"], r["tie"]), r["range"]) for r in numbered.mapInPandas(ends, schema).collect())
    out: dict[tuple[str, str, int], set[int]] = {}
    for i in range(1, len(found)):
        (before, left), (after, right) = found[i - 1], found[i]
        if left != right and before[0] == after[0]:
            for place, _ in found[max(0, i - WINDOW) : i]:
                out.setdefault(place, set()).add(right)
            for place, _ in found[i : i + WINDOW]:
                out.setdefault(place, set()).add(left)
    return out


def _number(cuts: list[tuple[str, str, int]]):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = zip(batch["host"], batch["path"], batch["tie"], strict=True)
            yield batch.assign(range=[bisect_right(cuts, place) for place in places])

    return number


def extract(pages: DataFrame, html_column: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """One row for each page: id, url, and its lines of main text."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col(id).alias("key"), F.col(url).alias("url"), F.col(html_column).alias("body"), F.xxhash64(F.col(id)).alias("tie"))
    kind = rows.schema["key"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts = [url_key(u) for u in batch["url"]]
            yield batch.drop(columns="url").assign(host=[h for h, _ in hosts], path=[p for _, p in hosts])[["host", "path", "tie"]]

    places = rows.select("url", "tie").mapInPandas(keys, "host string, path string, tie bigint")
    cuts = _cuts(places, int(spark.conf.get("spark.sql.shuffle.partitions")))
    outside = common.broadcast(spark, _outside(places, cuts))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts = [url_key(u) for u in batch["url"]]
            own = [(h, p, t) for (h, p), t in zip(hosts, batch["tie"], strict=True)]
            batch = batch.assign(host=[h for h, _ in hosts], path=[p for _, p in hosts], range=[bisect_right(cuts, x) for x in own], guest=False)
            yield batch
            guests = [(i, r) for i, x in enumerate(own) for r in outside.value.get(x, ())]
            if guests:
                yield batch.iloc[[i for i, _ in guests]].assign(range=[r for _, r in guests], guest=True)

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: deque = deque(maxlen=WINDOW)
        after: deque = deque()
        rows: list[tuple] = []

        def settle():
            """The result of the first page of `after`, whose neighbours are known."""
            row, own = after[0]
            if not row.guest:
                sides = ((list(before)[::-1], 0), (list(after)[1 : 1 + WINDOW], 1))
                near = [(-_common(row.path, r.path), far, side, lines) for pages, side in sides for far, (r, lines) in enumerate(pages) if r.host == row.host]
                lines = [x[3] for x in sorted(near, key=lambda x: x[:3])]
                rows.append((row.key, row.url, main_text(own, lines[0] if lines else None, lines[1:])))
            before.append(after.popleft())

        for batch in batches:
            for row in batch.itertuples(index=False):
                after.append((row._replace(body=None), lines_of(row.body)))
                if len(after) > WINDOW:
                    settle()
                if len(rows) >= 500:
                    yield _frame(rows)
                    rows = []
        while after:
            settle()
        if rows:
            yield _frame(rows)

    numbered = rows.mapInPandas(dealt, f"key {kind}, url string, body string, tie bigint, host string, path string, range int, guest boolean")
    ordered = numbered.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("host", "path", "tie", "body")
    out = ordered.mapInPandas(difference, f"key {kind}, url string, lines array<string>")
    return out.select(F.col("key").alias(id), F.col("url").alias(url), "lines")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "url", "lines"])
    if frame["key"].dtype == float:  # a null among whole numbers
        frame["key"] = pd.array([None if k is None or k != k else int(k) for k, *_ in rows], dtype="Int64")
    return frame


def digest(extracted: DataFrame, url: str = "url", id: str = "page_id") -> DataFrame:
    text = F.array_join("lines", " ")
    return extracted.select(id, url, text.alias("text"), F.length(text).cast("long").alias("n_chars"))
