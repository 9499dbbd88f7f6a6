"""HTML main text by template deduction: tokens with equal occurrence vectors over a host's pages form its template."""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, join_skewed, materialize, table

#: A class is valid with this share of its host's pages and so many tokens.
SUPPORT, TOKENS = 0.5, 2
#: A text is fixed if it stands on this share of its host's pages, and on so many at least. A host whose fixed texts outweigh the
#: others so many times has copies of one article, and no fixed texts.
FIXED, PAGES, COPIES = 0.9, 4, 4
#: The share of a host's text that a part of the template must hold for the article to be looked for inside it only.
REGION = 0.85
#: Elements nested deeper share the path of the one above; implied ends of elements are looked for so far up.
DEPTH, REACH = 64, 32
#: Names of an element up to so many characters stand in its path as they are; longer ones as a hash of them all.
LABEL = 64
#: Templates up to this size in all are broadcast to the pages; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_EDGE = re.compile(r"""["'>]""")
_ZEROS, _LONG = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)")

#: HTML's element kinds.
RAW = frozenset("script style noscript template iframe svg math title textarea object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: What isn't the article, by element, role or part of a class name or id; and what holds it.
DROP_TAGS = frozenset("nav header footer aside form button select input label menu dialog head fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status".split())
DROP_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo promotion"
    " banner cookie cookies consent notice notices alert newsletter subscribe subscription signup share sharing social related recommended comment comments reply replies"
    " respond disqus discussion responses popup modal overlay widget toolbar topbar pagination pager login search copyright disclaimer gdpr paywall adbox adslot adsbygoogle sidenav".split()
)
#: Parts of a name that make it tell how a page is laid out, as in has-sidebar or no-margin.
LAYOUT_NAMES = frozenset("layout has with without no".split())
#: Of DROP_NAMES those that an article may be about, as in search-study; they count alone or with words for parts
#: of a page only.
WEAK_NAMES = frozenset(
    "search share sharing social related menu login respond responses discussion notice notices alert banner signup promotion copyright consent reply replies header overlay"
    " widget navigation subscription cookie cookies disclaimer sponsor sponsored promo recommended".split()
)
PAGE_PARTS = frozenset(
    "box area bar list lists item items block section wrap wrapper container inner outer left right top bottom main site page global primary secondary content link links button"
    " buttons btn form icon icons group row col column panel region zone slot unit holder body head title text post posts article articles story stories news entry entries js id the".split()
)
KEEP_NAMES = frozenset("article post entry story content main".split())
ASIDE_ARTICLES = frozenset("comment comments reply replies ad ads advert promo sponsored related".split())
#: What holds a block, from nothing known to an article. What is dropped is never content, whatever the template says.
UNKNOWN, NAMED, MAIN, ARTICLE, DROP = 0, 1, 2, 3, 9


def drops(parts: set[str], above: int) -> bool:
    """Whether a class name or id of these parts names something that isn't the article. Inside an article a header is
    the article's own."""
    found = parts & DROP_NAMES - ({"header"} if above != UNKNOWN else set())
    return bool(found) and not parts & LAYOUT_NAMES and (bool(found - WEAK_NAMES) or {p for p in parts if len(p) > 2} <= WEAK_NAMES | PAGE_PARTS | DROP_NAMES)


def role_of(tag: str, attributes: str, above: int) -> tuple[str, int]:
    """The label of an element in a path, and its role given the role of what holds it."""
    label, names, role, dropped = tag, set(), "", False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = value.split()
                part = "".join(f".{re.sub(r'[0-9/#]+', '', w)}" for w in words)
                label += part if len(part) <= LABEL else f".{xxhash.xxh64_hexdigest(part.encode())}"
                for w in words:
                    parts = {p.lower() for p in _PART.findall(w)}
                    names |= parts
                    dropped |= drops(parts, above)
            elif name == "role":
                role = value.lower()
            elif (name == "hidden" and not value) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return label + ":hidden", DROP
    if above == DROP:
        return label, DROP
    if tag in ("article", "main") or role in ("main", "article"):
        if names & ASIDE_ARTICLES and not names & KEEP_NAMES:
            return label, DROP
        return label, max(above, ARTICLE if "article" in (tag, role) else MAIN)
    if tag in DROP_TAGS and not (tag == "header" and above != UNKNOWN) or role in DROP_ROLES:
        return label, DROP
    if tag not in ("html", "body") and names:
        if dropped:
            return label, DROP
        if names & KEEP_NAMES:
            return label, max(above, NAMED)
    return label, above


class _Tags:
    """The tags of a page, from left to right, in time linear in its length however broken it is.

    What doesn't end isn't a tag. Three things keep a failed look from being made again: whether a character comes at all
    any more, the next quote or end of tag, and the places behind quotes from which no tag ends."""

    def __init__(self, page: str):
        self.page, self.gone, self.edge, self.dead = page, set(), (0, -1), set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def _next_edge(self, at: int) -> int:
        known, place = self.edge
        if not known <= at <= place:
            m = _EDGE.search(self.page, at)
            self.edge = (at, m.start() if m else len(self.page))
        return self.edge[1]

    def end(self, at: int) -> int:
        """The place behind the '>' that ends the tag whose attributes start at `at`, quoted ones left out; -1 if none does."""
        tried = []
        while at not in self.dead:
            tried.append(at)
            k = self._next_edge(at)
            if k >= len(self.page):
                break
            if self.page[k] == ">":
                return k + 1
            k = self.find(self.page[k], k + 1)
            if k < 0:
                break
            at = k + 1
        self.dead.update(tried)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; the name of comments and declarations is empty."""
        while (start := self.find("<", at)) >= 0:
            at = start + 1
            m = _NAME.match(self.page, start)
            if m:
                end = self.end(m.end())
                if end > 0:
                    return start, end, m[1], m[2].lower(), self.page[m.end() : end - 1]
            elif self.page.startswith(("<!--", "<![CDATA["), start):
                mark = "-->" if self.page[start + 2] == "-" else "]]>"
                end = self.find(mark, start + 4)
                return start, end + 3 if end >= 0 else len(self.page), "", "", ""
            elif self.page.startswith(("<!", "<?"), start) and (end := self.find(">", start)) >= 0:
                return start, end + 1, "", "", ""
        return None


def _plain(text: str) -> str:
    """Text with its character references decoded; numbers beyond any character become the replacement character."""
    return html.unescape(_LONG.sub("\ufffd", _ZEROS.sub(r"\1", text)) if "&#" in text else text)


def parse(page: str) -> tuple[list[tuple[str, int, str, int, int]], dict[str, int]]:
    """(pieces, counts) of a page: its pieces of text in page order as (path, role, text, characters of it in links, number of
    the block); how often each path is opened. The parts of a block that have one role, one after the other, are a piece."""
    pieces: list[tuple[str, int, str, int, int]] = []
    counts: dict[str, int] = {}
    stack: list[tuple[str, str, int, str]] = [("", "", UNKNOWN, "")]  # tag, path, role, path of the block
    opened: dict[str, int] = {}
    held: list[tuple[str, str, int, bool]] = []
    block, links = 0, 0

    def flush() -> None:
        nonlocal block
        k = 0
        while k < len(held):
            upto = k
            while upto < len(held) and held[upto][2] == held[k][2]:
                upto += 1
            text = _plain("".join(x[0] for x in held[k:upto]))
            if text.strip():
                linked = min(len(text), sum(len(x[0].strip()) for x in held[k:upto] if x[3]))
                pieces.append((held[k][1], held[k][2], text, linked, block))
            elif text and pieces and pieces[-1][4] == block:
                path, role, before, linked, _ = pieces.pop()
                pieces.append((path, role, before + " ", linked, block))
            k = upto
        held.clear()
        block += 1

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            opened[e[0]] -= 1
            links -= e[0] == "a"
        del stack[k:]

    tags, at = _Tags(page), 0
    while True:
        found = tags.next(at)
        start = found[0] if found else len(page)
        if start > at:
            held.append((page[at:start], stack[-1][3], stack[-1][2], links > 0))
        if not found:
            break
        _, at, slash, tag, attributes = found
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if slash:
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag not in INLINE:
            ends, stop = (("p",), ("article", "section", "div", "body", "td", "li")) if tag not in CLOSES else (CLOSES[tag], WITHIN[tag])
            if any(opened.get(e) for e in ends):
                for k in range(len(stack) - 1, max(0, len(stack) - REACH), -1):
                    if k < len(stack) and stack[k][0] in ends:
                        close(k)
                        if tag in CLOSES and tag != "tr":
                            break
                    elif k < len(stack) and stack[k][0] in stop:
                        break
        label, role = role_of(tag, attributes, stack[-1][2])
        path = f"{stack[-1][1]}/{label}" if len(stack) <= DEPTH else stack[-1][1]
        if tag not in INLINE or role != stack[-1][2]:
            counts[path] = counts.get(path, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, path, role, stack[-1][3] if tag in INLINE else path))
            opened[tag] = opened.get(tag, 0) + 1
            links += tag == "a"
    flush()
    return pieces, counts


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _mark(text: str) -> str:
    return f"#{xxhash.xxh64_hexdigest(text.encode())}"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each token (a path, or a text of a path that isn't dropped) of a host, summed per partition.

    The occurrence vector of a token over all pages is kept as two sums of hashes of (page, count), which add up in
    any order; equal vectors have equal sums."""
    seen: dict[tuple[str, str], list[int]] = {}
    for b in batches:
        for page_id, url, page in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            blocks, counts = parse(page or "")
            sizes: dict[str, tuple[int, int]] = {}
            for path, role, text, link_chars, _ in blocks:
                if role != DROP:
                    text = " ".join(text.split())
                    key = path + _mark(text)
                    counts[key] = counts.get(key, 0) + 1
                    for token in (path, key):
                        chars, linked = sizes.get(token, (0, 0))
                        sizes[token] = (chars + len(text), linked + link_chars)
            host, page_key = host_of(url), f"{page_id}|{url}|"
            counts["*"] = 1
            for token, n in counts.items():
                h = xxhash.xxh64_intdigest(f"{page_key}{n}")
                chars, linked = sizes.get(token, (0, 0))
                own = seen.get((host, token))
                new = [1, n, h & 0xFFFFFFFF, h >> 32, chars, linked]
                seen[host, token] = new if own is None else [x + y for x, y in zip(own, new, strict=True)]
        if len(seen) > 100_000:
            yield _token_batch(seen)
            seen = {}
    yield _token_batch(seen)


TOKEN_COLUMNS = ("pages", "times", "low", "high", "chars", "linked")


def _token_batch(seen: dict) -> pa.RecordBatch:
    keys = list(seen)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([seen[k][c] for k in keys], pa.int64()) for c in range(6))]
    return pa.RecordBatch.from_arrays(columns, ["host", "token", *TOKEN_COLUMNS])


def nest(tokens: pd.DataFrame) -> tuple[set[str], dict[str, str]]:
    """The tokens of valid equivalence classes, and for each path among them the template path it is nested in.

    Tokens with the same vector form a class; a class is valid with TOKENS tokens or more, or if its one token lies
    directly below a path of a valid class and repeats evenly there (times a whole multiple of pages)."""
    classes = tokens.groupby(["low", "high", "pages"])["token"].agg(list)
    valid = {t for members in classes if len(members) >= TOKENS for t in members}
    for row in tokens.sort_values("token").itertuples():
        parent = row.token.rpartition("/")[0]
        if parent in valid and row.times % row.pages == 0:
            valid.add(row.token)
    inside = {}
    for t in valid:
        up = t.partition("#")[0].rpartition("/")[0] if "#" not in t else t.partition("#")[0]
        while up and up not in valid:
            up = up.rpartition("/")[0]
        inside[t] = up
    return valid, inside


def _template(tokens: pd.DataFrame) -> pd.DataFrame:
    """One host's template: the path that the article is looked for below, the paths whose slots hold content, those whose slots hold
    lists of links, those of cards, and fixed texts.

    A slot is what lies below a template path and below no deeper one, without fixed texts. It is a list of links if
    half of its text or more is in links. The region is reached from the page's root by going down to an element that stands once on
    its pages, holds other elements with text, and has REGION of the text of what it lies in: adverts and footers, however
    their texts vary, are little text beside an article. On a host of copies of one article nothing can be told by what repeats: its fixed texts
    are the mark '*'. Cards are article elements that repeat on a page beside one that
    stands once on each and that they aren't nested in: teasers of other stories."""
    pages = int(tokens["all"].iat[0])
    valid, inside = nest(tokens)
    times = {row.token: row.times / row.pages for row in tokens.itertuples()}
    articles = [t for t in valid if "#" not in t and re.match(r"article(?![\w-])", t.rpartition("/")[2])]
    single = {t for t in articles if times[t] == 1}

    def nested(path: str) -> bool:
        """Whether a path lies in the nest of a single article."""
        while path and path not in single:
            path = inside.get(path, "")
        return bool(path)

    cards = sorted(t for t in articles if single and times[t] >= 2 and not nested(t))
    texts = [row for row in tokens.itertuples() if "#" in row.token]
    everything = sum(row.chars for row in tokens.itertuples() if "#" not in row.token)
    fixed = [row for row in texts if row.token in valid and row.pages >= max(PAGES, FIXED * pages) and row.linked * 2 < row.chars]
    copies = sum(row.chars for row in fixed) > COPIES * (everything - sum(row.chars for row in fixed))
    if copies:
        fixed = []
    volume: dict[str, int] = {}
    held: dict[str, int] = {}  # text without links and fixed texts of each path and all below it
    for row in [*(row for row in tokens.itertuples() if "#" not in row.token and row.chars), *fixed]:
        path, text = row.token.partition("#")[::2]
        weight = (row.chars - row.linked) * (-1 if text else 1)
        slot, up = path, path
        while slot and slot not in valid:
            slot = slot.rpartition("/")[0]
        volume[slot] = volume.get(slot, 0) + (row.chars - 2 * row.linked) * (-1 if text else 1)
        while up:
            held[up] = held.get(up, 0) + weight
            up = up.rpartition("/")[0]
    linked = {row.token.partition("#")[0] for row in tokens.itertuples() if row.linked}
    paths = sorted(t for t in valid if "#" not in t)
    links = [t for t in paths if volume.get(t, 1) <= 0 and any(p == t or p.startswith(t + "/") for p in linked)]
    below: dict[str, list[str]] = {}
    for path in held:
        below.setdefault(path.rpartition("/")[0], []).append(path)
    region = ""
    while True:
        down = [p for p in below.get(region, ()) if p in valid and times[p] == 1 and below.get(p) and held[p] > 0 and held[p] >= REGION * held.get(region, held[p])]
        if not down:
            break
        region = max(down, key=held.__getitem__)
    return pd.DataFrame({"host": [tokens["host"].iat[0]], "region": [region], "slots": [[t for t in paths if t not in set(links)]], "links": [links], "cards": [cards], "fixed": [["*"] if copies else sorted(row.token for row in fixed)]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, region, slots, links, cards, fixed) of each host.

    Tokens are counted per partition and then per (host, token), so a hot host's pages are never brought together.
    Texts of few pages are left out before a host's tokens meet, and only tokens on SUPPORT of its pages reach its template, at most 1 / SUPPORT times as many as a page has."""
    kinds = "host string, token string, " + ", ".join(f"{c} long" for c in TOKEN_COLUMNS)
    tokens = pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_tokens, kinds)
    tokens = materialize(tokens.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS]).filter((F.col("pages") >= PAGES) | ~F.contains("token", F.lit("#"))))
    hosts = tokens.filter("token = '*'").select("host", F.col("pages").alias("all"))
    tokens = join_skewed(tokens.filter("token <> '*'"), hosts, ["host"], F.col("all") > hot_limit(max(1, pages_of(hosts)))).filter(F.col("pages") >= F.col("all") * SUPPORT)
    return tokens.groupBy("host").applyInPandas(_template, "host string, region string, slots array<string>, links array<string>, cards array<string>, fixed array<string>")


def pages_of(hosts: DataFrame) -> int:
    return hosts.agg(F.sum("all")).first()[0] or 0


def main_text(page: str, slots: Collection[str], fixed: Collection[str], links: Collection[str] = (), cards: Collection[str] = (), region: str = "") -> str:
    """The article of a page: the pieces in the content slots of its host's template that lie below its region, in page order,
    without fixed texts and without what an element marks as something else. What an article or main element holds counts
    wherever it lies, lists of links included. Cards are left out. On a host of copies (fixed is the mark '*') what an article or
    main element holds counts alone, where there is one.

    A page that the template leaves nothing of is read as one without a template: its pieces in article and main
    elements and in elements named like them, or every piece where it has no such element."""
    pieces = [b for b in parse(page)[0] if b[1] != DROP]
    within = lambda path, top: path == top or path.startswith(top + "/")

    def content(path: str) -> bool:
        if region and not within(path, region):
            return False
        while path and path not in slots and path not in links:
            path = path.rpartition("/")[0]
        return path not in links

    if cards:
        pieces = [b for b in pieces if not any(within(b[0], c) for c in cards)]
    if slots or links:
        named = "*" in fixed and any(b[1] >= MAIN for b in pieces)
        own = [b for b in pieces if (b[1] >= MAIN or (not named and content(b[0]))) and b[0] + _mark(" ".join(b[2].split())) not in fixed]
        if own:
            return _joined(own)
    marked = any(b[1] >= MAIN for b in pieces)
    return _joined([b for b in pieces if b[1] != UNKNOWN or not marked])


def _joined(pieces: list[tuple[str, int, str, int, int]]) -> str:
    """The text of pieces: those of one block run on as they stand in the page, blocks are apart."""
    out, last = [], None
    for _, _, text, _, block in pieces:
        out += [text] if block == last else [" ", text]
        last = block
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[str, tuple] = {}
    for b in batches:
        texts = []
        for url, page, *template in zip(*(b.column(k).to_pylist() for k in ("url", "html", "slots", "fixed", "links", "cards", "region")), strict=True):
            host = host_of(url)
            if host not in sets:
                if len(sets) > 1_000:
                    sets.clear()
                sets[host] = (*(set(part or ()) for part in template[:4]), template[4] or "")
            texts.append(main_text(page or "", *sets[host]))
        columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null, empty and unparsable pages give an empty text. Pages without a host share one template. Repeated rows get a row
    each, and count as pages of their own in the template. Other columns are ignored. Nothing is cut, however long the
    page, and broken markup takes no longer than other text. Templates are broadcast below BROADCAST_BYTES; beyond, those of
    hot hosts are, and the others meet their pages by a shuffle."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    found = materialize(templates(rows))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    rows = rows.withColumn("host_of_url", host)
    known = found.withColumnRenamed("host", "host_of_url")
    size = found.agg(F.sum(F.length("host") + F.length(F.array_join(F.concat("slots", "links", "cards", "fixed"), ",")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(known), "host_of_url", "left")
    else:
        sizes = rows.groupBy("host_of_url").agg(F.count(F.lit(1)).alias("_pages"))
        total = sizes.agg(F.sum("_pages")).first()[0]
        rows = join_skewed(rows, known.join(sizes, "host_of_url"), ["host_of_url"], F.col("_pages") > hot_limit(total))
    return rows.select("page_id", "url", "html", "slots", "links", "cards", "fixed", "region").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
