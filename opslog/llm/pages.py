"""The main text of web pages, with a suffix array of each host's pages to find boilerplate.

A page is read once into blocks of text. Elements say which blocks may be its text: those in an article,
else a main part, else teasers, else open text; what stands in menus, headers, footers, side bars,
notices, adverts, forms and comments may not. Which of these blocks are boilerplate is decided by the
suffix arrays of the page's host:

- The arrays hold the suffix at every word of the text blocks of all pages, cut to the length of a run and not
  beyond its block. A run that at least half of the host's pages show is boilerplate, such as notices that no element
  marks, wherever in a block it stands; what such runs cover goes from articles, main parts and teasers. Runs are
  checked against the pages: one of whose words they cover half or more is a copy of others; it does not count as
  showing boilerplate and keeps its whole text.
- Open text has no element to tell it from boilerplate, so hosts with open pages have a second array of every
  suffix outside articles, over blocks too. A run of tokens that begins suffixes of two distinct pages is
  boilerplate wherever it is; what such runs cover goes.

The first arrays are built by doubling, each of a group of a host's pages of bounded size: a run on half of the host's
pages is on half of those of one group at least, so what the groups find is all there can be, and is then counted over
all pages. The second is a range-partitioned sort of all suffixes of all hosts; a host or a run with very many
suffixes spreads over many tasks, and what a task cannot decide at its two ends is settled by a small
table of those ends.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays
from opslog.session import stage

#: Tokens of a run that is boilerplate if it repeats.
RUN = 8
#: Pages of a host that show a run of an article which is boilerplate: so many, and this share of all.
CARRIERS, SHARE = 3, 0.5
#: Words of a group of a host's pages, whose suffix array a task holds, and pages of a group at least.
GROUP_WORDS, GROUP_PAGES = 1 << 18, 16
#: Words whose codes a task keeps.
KEPT_CODES = 1 << 17

#: Element names and words of class, id and role that say what an element is for.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "noscript", "template", "svg",
         "object", "canvas", "audio", "video", "head", "datalist"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
               "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside",
               "comment", "comments", "disqus", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter",
               "subscribe", "share", "sharing", "social", "related", "search", "login", "signup", "widget"}
ENDS_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
             "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_P = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
                     "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
                     "search", "section", "summary", "table", "ul", "li", "dd", "dt"}
IN_HEAD = {"base", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
OF_TEXT = HEADINGS | {"p", "pre", "blockquote", "td", "dd"}
TEASERS = {"teaser", "card", "preview", "summary"}

# no part of a match is tried twice, so that a broken page is read in linear time too
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
WORD = re.compile(r"[a-z0-9]+")
ARTICLE, MAIN, TEASER, OPEN, DROP = "article", "main", "teaser", "open", "drop"
#: The header of an article or main part: only its headings belong to the text.
HEADER_OF = {ARTICLE: "article header", MAIN: "main header"}
HEADED = {v: k for k, v in HEADER_OF.items()}


def attributes(raw: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def purpose(name: str, raw: str, in_text: bool = False) -> str | None:
    """What an element makes of what stands in it; ``None`` if it says nothing.

    Words of class and id count for parts of pages, not for marks on words ``in_text``. An article is
    judged by whole class names only, as names such as ``with-sidebar`` describe its layout.
    """
    own = attributes(raw) if raw.strip() else {}
    role = own.get("role", "").lower()
    if name in ASIDE or role in ASIDE_ROLES or "hidden" in own or "display:none" in own.get("style", "").replace(" ", ""):
        return DROP
    if name == "article" or own.get("itemprop", "").lower() == "articlebody":
        whole = set(own.get("class", "").lower().split())
        return DROP if whole & ASIDE_WORDS else TEASER if whole & TEASERS else ARTICLE
    if own and not in_text and name not in HEADINGS and name not in ("html", "body", "main"):
        if ASIDE_WORDS & set(WORD.findall(f"{own.get('class', '')} {own.get('id', '')}".lower())):
            return DROP
    return MAIN if name == "main" or role == "main" else None


class Codes(dict):
    """The tokens of words."""

    def __missing__(self, word: str) -> int:
        code = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < KEPT_CODES:
            self[word] = code
        return code

    def of(self, text: str) -> np.ndarray:
        words = text.split(" ")
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def covered_words(text: str, runs: set[bytes], run: int, codes: Codes) -> tuple[set[int], set[bytes]]:
    """The words of a block that ``runs`` cover, by place, and which of the runs do."""
    if text.count(" ") + 1 < run:
        return set(), set()
    raw = codes.of(text).tobytes()
    own = [(p, r) for p in range(len(raw) // 4 - run + 1) if (r := raw[4 * p:4 * (p + run)]) in runs]
    return {p + k for p, _ in own for k in range(run)}, {r for _, r in own}


@dataclass
class Page:
    """Blocks of a page in order: what they are in, their text, and where their tokens stand in the stream."""

    blocks: list[tuple[str, str, int]] = field(default_factory=list)
    stream: list[int] = field(default_factory=list)

    def kinds(self) -> tuple[str, ...]:
        """The kind of blocks that are the page's text: its articles, else its main part, teasers or open text."""
        have = {k for k, _, _ in self.blocks}
        return (next((k for k in (ARTICLE, MAIN, TEASER) if k in have), OPEN),)

    def text(self, covered: set[int] = frozenset(), carried: set[bytes] = frozenset(), run: int = RUN) -> str:
        """The main text without words of open blocks that ``covered`` names, or words of others that ``carried`` runs cover."""
        wanted = self.kinds()
        blocks = [(kind, text, at) for kind, text, at in self.blocks if kind in wanted]
        gone = [covered if kind == OPEN else set() for kind, _, _ in blocks]
        if carried and OPEN not in wanted:
            codes = Codes()
            frame = [{at + i for i in covered_words(text, carried, run, codes)[0]} for _, text, at in blocks]
            # a page that is mostly carried by others is their copy, not their frame
            if 2 * sum(map(len, frame)) < sum(text.count(" ") + 1 for _, text, _ in blocks):
                gone = frame
        parts = []
        for (_, text, at), off in zip(blocks, gone):
            if off:
                text = " ".join(w for i, w in enumerate(text.split(" "), at) if i not in off)
            if text:
                parts.append(text)
        return " ".join(parts)


class Nesting:
    """The open elements with what they make of their text; every question takes the same time at any depth."""

    def __init__(self):
        self.stack, self.depths, self.solid = [("", OPEN)], {}, []

    @property
    def kind(self) -> str:
        return self.stack[-1][1]

    def inside(self) -> str:
        """The innermost open element that is not inline."""
        return self.stack[self.solid[-1]][0] if self.solid else ""

    def last(self, *names: str) -> int:
        """The depth of the innermost open element of these names, 0 if none is open."""
        return max(self.depths[n][-1] if self.depths.get(n) else 0 for n in names)

    def push(self, name: str, kind: str):
        self.depths.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((name, kind))

    def close(self, depth: int):
        """Close the element at ``depth`` and all within it."""
        while len(self.stack) > depth:
            name, _ = self.stack.pop()
            self.depths[name].pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()

    def make_room(self, name: str):
        """Close what a new element of this name ends: the head, a paragraph, the item before it."""
        if self.stack[-1][0] == "head" and name not in IN_HEAD:
            self.close(len(self.stack) - 1)
        if name in ENDS_P and self.inside() == "p":
            self.close(self.solid[-1])
        if name in ENDS_SELF:
            before = self.last(*SIBLINGS.get(name, (name,)))
            if before > self.last(*ENDS_SELF[name]):
                self.close(before)


def read(source: str) -> Page:
    """Read a page in time linear in its length. Broken markup is read as far as it goes.

    A tag or comment that the end of the page cuts off is no text, as in a browser.
    """
    page, nest, text = Page(), Nesting(), []
    at, end = 0, len(source)

    def close_block():
        words = "".join(text).split()
        text.clear()
        if words:
            page.blocks.append((nest.kind, " ".join(words), len(page.stream)))
            if nest.kind != ARTICLE:
                page.stream.extend(zlib.crc32(w.encode("utf-8", "replace")) for w in words)

    while at < end:
        if source[at] != "<":
            start, at = at, source.find("<", at)
            at = end if at < 0 else at
            text.append(html.unescape(source[start:at]))
            continue
        follows = source[at + 1:at + 2]
        if follows in ("!", "?") or (follows == "/" and not re.match("[a-zA-Z]", source[at + 2:at + 3])):
            if source.startswith("<!--", at) and not source.startswith((">", "->"), at + 4):
                close = COMMENT_END.search(source, at + 4)
                at = close.end() if close else end
            else:
                at = source.find(">", at) + 1 or end
            continue
        if follows != "/" and not re.match("[a-zA-Z]", follows):
            text.append("<")
            at += 1
            continue
        token = TAG.match(source, at)
        if token is None:
            break
        at, name = token.end(), token[2].lower()
        inline = name in INLINE
        if not inline:
            close_block()
        if token[1]:
            depth = nest.last(name)
            # the end of an inline element does not end a block within it
            if depth and not (inline and nest.solid and nest.solid[-1] > depth):
                if inline and nest.kind != nest.stack[depth - 1][1]:
                    close_block()
                nest.close(depth)
            if not inline and nest.kind != ARTICLE:
                page.stream.append(zlib.crc32(f"</{name}>".encode()))
            continue
        if not inline:
            nest.make_room(name)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else end
            nest.push(name, DROP)
            continue
        if name in VOID or (token[3].endswith("/") and name in ("svg", "path")):
            continue
        outer = nest.kind
        kind = purpose(name, token[3], inline and nest.inside() in OF_TEXT)
        if name == "header" and outer in HEADER_OF:
            kind = HEADER_OF[outer]
        elif outer in HEADED:
            kind = DROP if kind == DROP else HEADED[outer] if name in HEADINGS else outer
        elif outer == DROP or kind is None or (outer == ARTICLE and kind in (MAIN, TEASER)):
            kind = outer
        if inline and kind != outer:
            close_block()
        nest.push(name, kind)
        if not inline and kind != ARTICLE:
            page.stream.append(zlib.crc32(f"<{name}>".encode()))
    close_block()
    return page


def suffixes(pages: DataFrame, run: int) -> DataFrame:
    """``host``, ``page``, ``pos`` and the first ``run`` tokens of every long enough suffix of the streams."""
    def cut(batch: pa.RecordBatch):
        rows, places, heads = [], [], []
        for i, raw in enumerate(batch.column(2).to_pylist()):
            n = len(raw) // 4 - run + 1
            if n > 0:
                rows += [i] * n
                places += range(n)
                heads += [raw[4 * p:4 * (p + run)] for p in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
             pa.array(places, pa.int32()), pa.array(heads, pa.binary())], names=["host", "page", "pos", "head"])

    return arrays.map_batches(pages.where("host is not null").select("host", "page", "stream"), cut,
                              "host string, page long, pos int, head binary")


def repeated(pages: DataFrame, run: int = RUN) -> DataFrame:
    """``page`` and ``pos`` of every run of tokens that two distinct pages of a host show.

    ``pages`` has ``host``, ``page`` and ``stream``, the tokens in four bytes each.
    """
    order = ["host", "head", "page", "pos"]
    array = suffixes(pages, run).repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours in the array: 1 for a run on two pages, 0 for one on one, 2 where a task cannot tell."""
        held, key, first = [], None, True

        def give(state):
            nonlocal held
            out = pa.Table.from_batches(held)
            held = []
            yield from out.append_column("state", pa.array(np.full(out.num_rows, state, np.int32))).to_batches()

        settled = False
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, heads, owner = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_numpy()
            cuts = [i for i in range(batch.num_rows) if i == 0 or (hosts[i], heads[i]) != (hosts[i - 1], heads[i - 1])]
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if (hosts[a], heads[a]) != key:
                    if held:
                        yield from give(1 if settled else 2 if first else 0)
                    first = key is None
                    key, settled, one = (hosts[a], heads[a]), False, owner[a]
                held.append(batch.slice(a, b - a))
                if settled or owner[a] != one or owner[b - 1] != one:
                    settled = True
                    yield from give(1)
        if held:
            yield from give(1 if settled else 2)

    scanned = stage(array.mapInArrow(scan, "host string, page long, pos int, head binary, state int").where("state > 0"),
                    "suffixes")
    ends = scanned.where("state = 2").groupBy("host", "head").agg(F.min("page").alias("x"), F.max("page").alias("y"))
    sure = scanned.where("state = 1").select("host", "head").distinct()
    # a task leaves at most its first and its last run open
    open_ = scanned.where("state = 2").join(F.broadcast(ends.where("x < y").select("host", "head")), ["host", "head"], "left_semi")
    rest = scanned.where("state = 2").join(F.broadcast(ends.where("x = y").select("host", "head")), ["host", "head"], "left_semi")
    met = rest.join(sure, ["host", "head"], "left_semi")
    return scanned.where("state = 1").select("page", "pos").union(open_.select("page", "pos")).union(met.select("page", "pos"))


def suffix_ranks(tokens: np.ndarray, run: int) -> np.ndarray:
    """The place in the suffix array of each suffix of at least ``run`` tokens, cut to these; equal ones share a place."""
    if len(tokens) < run:
        return np.empty(0, np.int64)
    ranks, done = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while done < run:
        step = min(done, run - done)
        ranks = np.unique(ranks[:len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:], return_inverse=True)[1]
        done += step
    return ranks


def packed_blocks(pages: DataFrame, run: int) -> DataFrame:
    """``host``, ``page`` and ``packed``, the text of its blocks that are as long as a run."""
    def pack(batch: pa.RecordBatch):
        packed = [zlib.compress("\n".join(t for t in texts if t.count(" ") + 1 >= run).encode(), 1)
                  for texts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                         names=["host", "page", "packed"])

    return arrays.map_batches(pages.where("host is not null and size(parts) > 0").select("host", "page", "parts.text"), pack,
                              "host string, page long, packed binary")


def candidates(pages: DataFrame, hosts: DataFrame, run: int) -> DataFrame:
    """``host`` and ``head`` of every run that may be on a large enough share of the host's pages.

    ``hosts`` has ``host`` and ``groups``, into how many its pages are dealt. A group's suffix array gives the runs
    that this share of its pages shows; a run that has the share of all pages has it in one of the groups.
    """
    some = F.broadcast(hosts.where("groups > 1").select("host", "groups"))  # at most one in GROUP_WORDS words
    codes = Codes()
    dealt = packed_blocks(pages, run).join(some, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("page"), F.col("groups")))

    def often(table: pa.Table) -> pa.Table:
        owner, first = np.unique(table["page"].to_numpy(), return_index=True)
        need = max(SHARE * len(owner), CARRIERS if table["groups"][0].as_py() == 1 else 1)
        heads = []
        if need <= len(owner):
            texts = [zlib.decompress(b).decode().split("\n") for b in table["packed"].take(pa.array(first)).to_pylist()]
            blocks = [[codes.of(t) for t in own if t] for own in texts]
            sizes = np.array([len(c) for own in blocks for c in own], np.int64)
            tokens = np.concatenate([np.empty(0, np.uint32), *(c for own in blocks for c in own)])
            ends = np.repeat(np.cumsum(sizes), sizes)
            of = np.repeat(np.arange(len(blocks)), [sum(map(len, own)) for own in blocks])
            ranks = suffix_ranks(tokens, run)
            at = np.flatnonzero(np.arange(len(ranks)) + run <= ends[:len(ranks)])
            shown = np.unique(ranks[at] * len(owner) + of[at]) // len(owner)
            where, count = np.unique(ranks[at], return_index=True)[1], np.unique(shown, return_counts=True)[1]
            heads = [tokens[p:p + run].tobytes() for p in at[where[count >= need]].tolist()]
        return pa.table({"host": pa.array([table["host"][0].as_py()] * len(heads), pa.string()),
                         "head": pa.array(heads, pa.binary())})

    return dealt.groupBy("host", "part").applyInArrow(often, "host string, head binary").distinct()


def showing(pages: DataFrame, runs: DataFrame, run: int) -> DataFrame:
    """``host``, ``page`` and ``heads`` of the pages that show ``runs`` (``host``, ``heads``), each once.

    Also the ``words`` that these runs cover, and the ``total`` of the page.
    """
    codes, sets = Codes(), {}

    def find(batch: pa.RecordBatch):
        out, hosts, texts, given = [], batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        for i, host in enumerate(hosts):
            if host not in sets:
                if len(sets) > 100:
                    sets.clear()
                sets[host] = set(given[i].as_py())
            found = [covered_words(t, sets[host], run, codes) for t in texts[i]]
            out.append((sorted(set().union(*(heads for _, heads in found))), sum(len(c) for c, _ in found),
                        sum(t.count(" ") + 1 for t in texts[i])))
        heads, words, totals = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.binary())), pa.array(words, pa.int64()),
             pa.array(totals, pa.int64())], names=["host", "page", "heads", "words", "total"])

    asked = pages.where("size(parts) > 0").join(runs, "host").select("host", "page", "parts.text", "heads")
    return arrays.map_batches(asked, find, "host string, page long, heads array<binary>, words long, total long").where(
        "size(heads) > 0").dropDuplicates(["host", "page"])


def carried(pages: DataFrame, run: int = RUN) -> DataFrame:
    """``host`` and ``heads``, the runs that a large share of its pages show beside text of their own.

    ``pages`` has ``host``, ``page``, ``parts``, the text blocks of the page, and their ``words``.
    """
    hosts = stage(pages.where("host is not null").groupBy("host").agg(
        F.countDistinct("page").alias("pages"), F.sum("words").alias("words")).select(
        "host", F.greatest(F.lit(CARRIERS), F.col("pages") * SHARE).alias("least"),
        F.least(F.ceil(F.col("words") / GROUP_WORDS), F.ceil(F.col("pages") / GROUP_PAGES)).cast("int").alias("groups")), "hosts")
    runs = lambda found: found.groupBy("host").agg(F.collect_list("head").alias("heads"))

    def enough(shown: DataFrame) -> DataFrame:
        counts = shown.select("host", F.explode("heads").alias("head")).groupBy("host", "head").agg(F.count("*").alias("n"))
        return counts.join(hosts, "host").where("n >= least").select("host", "head")

    # staged, so that the plans of the next joins know how little it is
    maybe = stage(runs(candidates(pages, hosts, run)), "candidates")
    often = stage(runs(enough(showing(pages, maybe, run))), "often")
    return stage(runs(enough(showing(pages, often, run).where("2 * words < total"))), "carried")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", run: int = RUN) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    in page order by one space. Every page is read once; the suffix arrays of its host then decide which of
    its words are boilerplate.

    Edge cases: a null or empty page has an empty text; a page without a host, or alone on its host, has
    no repeated runs, and one on a host of fewer than three pages no carried runs; rows that repeat a
    key with the same source are one page; broken or cut markup is read as far as it goes; other columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"),
        F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"),
    ).withColumn("host", F.when(F.col("host") != "", F.col("host"))).withColumn("page", F.xxhash64("key", "html"))
    kind = pages.schema[key].dataType.simpleString()

    def once(batch: pa.RecordBatch):
        kinds, parts, words, streams = [], [], [], []
        for source in batch.column(4).to_pylist():
            page = read(source or "")
            wanted, = page.kinds()
            kinds.append(wanted)
            parts.append([{"text": t, "at": a} for k, t, a in page.blocks if k == wanted])
            words.append(sum(p["text"].count(" ") + 1 for p in parts[-1]))
            streams.append(np.array(page.stream, ">u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(kinds, pa.string()),
             pa.array(parts, pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))), pa.array(words, pa.int64()),
             pa.array(streams, pa.binary())],
            names=["key", "url", "host", "page", "kind", "parts", "words", "stream"])

    def finish(batch: pa.RecordBatch):
        texts = []
        for kind, parts, heads, spots in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            covered = {p + k for p in spots or () for k in range(run)}
            texts.append(Page([(kind, p["text"], p["at"]) for p in parts]).text(covered, set(heads or ()), run))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["key", "url", "text"])

    seen = stage(arrays.map_batches(
        rows.select("key", "url", "host", "page", "html"), once,
        f"key {kind}, url string, host string, page long, kind string, parts array<struct<text: string, at: int>>, words long, "
        "stream binary"), "pages", compression="zstd")
    is_open = (F.col("kind") == OPEN) & (F.size("parts") > 0)
    no_spots, no_heads = F.lit(None).cast("array<int>").alias("spots"), F.lit(None).cast("array<binary>").alias("heads")
    columns = ["key", "url", "kind", "parts"]
    ready = seen.where(~is_open).join(carried(seen, run), "host", "left").select(*columns, "heads", no_spots)
    left = seen.where(is_open)
    if not left.isEmpty():
        asked = left.select("host").where("host is not null").distinct()
        runs = repeated(seen.join(asked, "host", "left_semi"), run).join(
            left.select("page").distinct(), "page", "left_semi").groupBy("page").agg(F.collect_set("pos").alias("spots"))
        ready = ready.union(left.join(runs, "page", "left").select(*columns, no_heads, "spots"))
    done = arrays.map_batches(ready, finish, f"key {kind}, url string, text string")
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text",
                       F.char_length("text").cast("long").alias("n_chars"))
