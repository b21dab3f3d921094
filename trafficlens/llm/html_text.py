"""Main text of web pages: page structure, and repeated substrings of each host.

A page is read as blocks of text. Blocks inside an article or main element are its
text; blocks in menus, headers, footers, side columns, notices, adverts, forms and
reader comments are not, also if articles stand inside these or are comments themselves.
On a page where such elements hold little or none of the text the blocks outside all
of these remain too.

The tokens of all blocks of a page are one stream. A run of tokens that many distinct
pages of a host share is boilerplate: it goes from the blocks that remain, and inside
main blocks if it is long. Suffixes whose first ``depth`` tokens agree are an interval of
the host's sorted suffixes; a longer common prefix covers no other tokens than its
parts of that depth do, so such intervals, found by a hash of host and prefix, find all
that is covered, and covered parts that meet or overlap are one run. Most suffixes need
not be compared: each window of ``depth`` tokens has an anchor, its least short run, and
only windows whose anchor stands on several pages of the host can repeat.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches, stored, temporary, temporary_path, with_fields
from trafficlens.llm.words import mix, words
from trafficlens.sources.sinks import cut
from trafficlens.sources.workspace import remove_tree

# What elements mean, and words in class, id and role that name side matter.
NO_TEXT = frozenset("head script style noscript template svg math iframe object canvas select textarea title".split())
SIDE = frozenset("nav header footer aside form menu dialog button".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# words of the short runs that stand for longer ones
ANCHOR_WORDS = 5
# rows of several pages that a task sends on at once
_ROWS_AT_ONCE = 1 << 17
# main blocks with a smaller part of a page's text than this do not stand for the page
SMALL_PART = 0.25

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")}


@dataclass(frozen=True)
class Boilerplate:
    """depth: tokens that must agree on pages of a host for a run to be boilerplate.

    main_depth: tokens of a run, of parts of that depth, that goes from main blocks too.
    pages, share: distinct pages that must agree, at least, and as a part of the host's.
    """

    depth: int = 12
    main_depth: int = 20
    pages: int = 3
    share: float = 0.05


class _Inside(NamedTuple):
    """Whether an element stands in main text, in side matter, or in a form before any main text."""

    main: bool = False
    side: bool = False
    form: bool = False
    kind: str = "open"

    def with_element(self, name: str, meaning: str) -> "_Inside":
        # a form around main text is that of the whole page
        form = self.form or (meaning == "side" and name == "form" and not self.main)
        side = self.side or (meaning == "side" and not (name == "form" and not self.main))
        main = self.main or meaning == "main"
        return _Inside(main, side, form, "side" if side or (form and not main) else "main" if main else "open")


_OUTSIDE = _Inside()


@dataclass
class _Reader:
    """Blocks of a page as (kind, text): kind "main", "open" or "side"."""

    blocks: list[tuple[str, str]] = field(default_factory=list)
    # open elements: name, meaning and what they make of the text inside
    stack: list[tuple[str, str | None, "_Inside"]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)

    def kind(self) -> str:
        return self.stack[-1][2].kind if self.stack else "open"

    def flush(self) -> None:
        if self.text:
            joined = " ".join(unescape("".join(self.text)).split())
            if joined:
                self.blocks.append((self.kind(), joined))
            self.text = []

    def open(self, name: str, attributes: str) -> None:
        meaning = _meaning(name, attributes)
        if name in BLOCK or meaning:
            self.flush()
        if name == "p":
            self._close_paragraph()
        if name not in VOID and not attributes.rstrip().endswith("/"):
            inside = self.stack[-1][2] if self.stack else _OUTSIDE
            self.stack.append((name, meaning, inside.with_element(name, meaning) if meaning else inside))

    def _close_paragraph(self) -> None:
        """A new paragraph closes an open one, also from inside its inline elements."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p":
                del self.stack[i:]
                return
            if self.stack[i][0] in BLOCK:
                return

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                if name in BLOCK or any(k for _, k, _ in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                return
            # an inline end tag does not reach beyond its block
            if name not in BLOCK and self.stack[i][0] in BLOCK:
                return
        if name in BLOCK:
            self.flush()


def _meaning(name: str, attributes: str) -> str | None:
    """ "main", "side" or nothing, from an element's name and attributes."""
    if name in SIDE:
        return "side"
    if attributes and name not in ("html", "body"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return "side"
            if key == "role" and value in SIDE_ROLES:
                return "side"
            if key == "role" and value in ("main", "article"):
                return "main"
            if key in ("class", "id"):
                named = _WORD.findall(value)
                if name in CONTENT:
                    # main text may say that it has comments; a comment is named so first
                    named = [found[0] for x in value.split() if (found := _WORD.findall(x))]
                if not SIDE_WORDS.isdisjoint(named):
                    return "side"
    return "main" if name in CONTENT else None


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    """The text blocks of a page in order, each with "main", "side" or "open".

    Character references are decoded and white space becomes one space. Elements that
    are not text are left out. A page without a main block has no "main".
    """
    html, at, reader = html or "", 0, _Reader()
    while True:
        tag = _TAG.search(html, at)
        if tag is None:
            reader.text.append(html[at:])
            break
        begin = tag.start()
        if begin > at:
            reader.text.append(html[at:begin])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            reader.close(name)
        elif name in NO_TEXT:
            reader.text.append(" ")
            end = _RAW.get(name) or re.compile(rf"</{name}\s*>", re.IGNORECASE)
            close = end.search(html, at)
            # without an end tag a head or select ends where the next body begins
            if close:
                at = close.end()
            elif name in ("script", "style", "textarea", "title"):
                at = len(html)
        elif name == "br":
            reader.text.append(" ")
        else:
            reader.open(name, tag[3] or "")
    reader.flush()
    return reader.blocks


def _is_small(blocks: list[tuple[str, str]]) -> bool:
    """Whether main blocks are missing or hold little of the text outside side matter."""
    main, other = (sum(len(text) for kind, text in blocks if kind == k) for k in ("main", "open"))
    return main < SMALL_PART * (main + other) or not main


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", (url or "").strip(), re.IGNORECASE)
    return found[1].lower() if found else ""


def main_text(pages: DataFrame, how: Boilerplate = Boilerplate()) -> DataFrame:
    """All columns of ``pages`` (page_id, url, html) with text and n_chars.

    Blocks are joined by line feeds. A null or empty page has an empty text. Pages
    without a host are one host. Pages of equal words on a host count as one, so their
    agreement is no boilerplate. Every row is returned; columns of the input with these
    names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*kept)
    page = F.xxhash64("page_id", "url", "html")
    plain = pages.select("url", "html", page.alias("page"))
    with temporary(pages):
        path = temporary_path(pages, "anchors")
        marks = cut(map_batches(plain, _anchors(how), "page long, content long, host long, anchor long"), path)
        sizes = marks.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents"))
        least = stored(sizes.select("host", F.greatest(F.lit(how.pages), F.ceil(F.col("contents") * how.share)).alias("least")), "hosts")
        # an anchor on one content only is in no repeat; one exchange of the anchors tells that
        beside = Window.partitionBy("anchor")
        several = F.min("content").over(beside) < F.max("content").over(beside)
        anchors = marks.filter("anchor IS NOT NULL").select("page", "anchor", several.alias("several"))
        asked = stored(anchors.filter("several").groupBy("page").agg(F.collect_set("anchor").alias("_anchors")), "asked")
        remove_tree(pages.sparkSession, path)
        # suffixes that hold such an anchor within their depth; equal prefixes are an interval of the sorted suffixes
        # text travels compressed, markup stays behind
        some = map_batches(plain, _packed, "page long, host long, packed binary").join(asked, "page")
        suffixes = stored(map_batches(some, _suffixes(how), "host long, page long, content long, prefix long, at int"), "suffixes")
        on = suffixes.select("host", "prefix", "content").distinct().groupBy("host", "prefix").agg(F.count("*").alias("many"))
        repeated = stored(on.join(least, "host").filter("many >= least").select("host", "prefix"), "intervals")
        covered = suffixes.join(repeated, ["host", "prefix"]).groupBy("page").agg(F.collect_set("at").alias("_covered"))
        covered = stored(covered, "covered", keep=True)
    joined = pages.withColumn("page", page).join(covered, "page", "left").select(*kept, "_covered")
    return map_batches(joined, _extractor(how), with_fields(pages, text="string", n_chars="long"))


def _text_of(htmls: pa.Array) -> list[str]:
    """The texts of all blocks of each page one after another."""
    return [" ".join(text for _, text in page_blocks(html.as_py())) for html in htmls]


def _streams(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, token hashes) of pages: the tokens of all blocks of a page one after another."""
    for part in words(pa.array(texts, pa.string())):
        for i in range(len(part)):
            yield part.first + i, part.hashes[part.offsets[i] : part.offsets[i + 1]]


def _run_hashes(own: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` of at least that many tokens."""
    # an odd factor for each place
    turns = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(len(own) - size + 1, np.uint64)
    for k in range(size):
        out += own[k : len(own) - size + 1 + k] * turns[k]
    return mix(out)


def _content(own: np.ndarray) -> int:
    spread = mix(own + np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(spread.sum(dtype=np.uint64).view(np.int64))


def _host_key(url: str | None) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(host_of(url).encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)


def _anchored(own: np.ndarray, host: np.ndarray, how: Boilerplate) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all short runs, whether a run is the least of one of the windows of ``depth`` tokens it stands in).

    A repeat of ``depth`` tokens has the same least run wherever it stands.
    """
    keys = mix(_run_hashes(own, ANCHOR_WORDS) ^ host)
    width = how.depth - ANCHOR_WORDS + 1
    least = _over_windows(np.minimum, keys, width)
    # a run is the least of a window if it is the greatest of what the windows around it have as least
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    return keys, keys == _over_windows(np.maximum, around, width)


def _over_windows(of: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``of`` (minimum, maximum, logical or) over each window of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = of(values[:-step], values[step:])
        done += step
    return values


def _anchors(how: Boilerplate):
    """The anchors of every page; a page too short for any has one row without."""

    def take(batches):
        for batch in batches:
            urls, pages = batch.column("url"), batch.column("page").to_numpy()
            for row, own in _streams(_text_of(batch.column("html"))):
                host, found = _host_key(urls[row].as_py()), np.zeros(0, np.int64)
                if len(own) >= how.depth:
                    keys, chosen = _anchored(own, host, how)
                    found = np.unique(keys[chosen]).view(np.int64)
                same = {"page": pages[row], "content": _content(own), "host": host.view(np.int64)[0]}
                yield same, {"anchor": pa.array(found) if len(found) else pa.nulls(1, pa.int64())}

    return lambda batches: _gathered(take(batches))


def _gathered(pages: Iterator[tuple[dict[str, int], dict[str, pa.Array]]]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many pages; given are the values that a page has in all of its rows, and its columns."""
    held, rows = [], 0
    for same, own in pages:
        held.append((same, own))
        rows += len(next(iter(own.values())))
        if rows >= _ROWS_AT_ONCE:
            yield _joined(held)
            held, rows = [], 0
    if held:
        yield _joined(held)


def _joined(pages: list[tuple[dict[str, int], dict[str, pa.Array]]]) -> pa.RecordBatch:
    lengths = [len(next(iter(own.values()))) for _, own in pages]
    columns = {k: pa.array(np.repeat(np.array([same[k] for same, _ in pages], np.int64), lengths)) for k in pages[0][0]}
    return pa.record_batch(columns | {k: pa.concat_arrays([own[k] for _, own in pages]) for k in pages[0][1]})


def _packed(batches):
    """Each page with the key of its host and its tokens, compressed."""
    for batch in batches:
        hosts = [int(_host_key(url.as_py()).view(np.int64)[0]) for url in batch.column("url")]
        texts = [zlib.compress(text.encode("utf-8"), 1) for text in _text_of(batch.column("html"))]
        columns = [batch.column("page"), pa.array(hosts, pa.int64()), pa.array(texts, pa.binary())]
        yield pa.record_batch(columns, names=["page", "host", "packed"])


def _suffixes(how: Boilerplate):
    """The first ``depth`` tokens of the suffixes of a page that hold one of its given anchors."""

    def take(batches):
        for batch in batches:
            pages, hosts, asked = (batch.column(name) for name in ("page", "host", "_anchors"))
            pages, hosts = pages.to_numpy(), hosts.to_numpy()
            texts = [zlib.decompress(packed.as_py()).decode("utf-8") for packed in batch.column("packed")]
            for row, own in _streams(texts):
                if len(own) < how.depth:
                    continue
                keys, chosen = _anchored(own, hosts[row : row + 1].view(np.uint64), how)
                given = chosen & np.isin(keys.view(np.int64), asked[row].values.to_numpy())
                at = np.flatnonzero(_over_windows(np.logical_or, given, how.depth - ANCHOR_WORDS + 1))
                prefix = _run_hashes(own, how.depth)[at]
                same = {"host": hosts[row], "page": pages[row], "content": _content(own)}
                yield same, {"prefix": pa.array(prefix.view(np.int64)), "at": pa.array(at.astype(np.int32))}

    return lambda batches: _gathered(take(batches))


def _extractor(how: Boilerplate):
    def extract(batches):
        for batch in batches:
            out = []
            for html, covered in zip(batch.column("html"), batch.column("_covered"), strict=True):
                at = covered.values.to_numpy() if covered.is_valid else ()
                out.append(_extracted(html.as_py(), at, how))
            names = [c for c in batch.schema.names if c != "_covered"]
            arrays = [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.record_batch([*(batch.column(c) for c in names), *arrays], names=[*names, "text", "n_chars"])

    return extract


def _extracted(html: str | None, covered, how: Boilerplate) -> str:
    blocks = page_blocks(html)
    small = _is_small(blocks)
    wanted = [kind == "main" or (kind == "open" and small) for kind, _ in blocks]
    if not len(covered):
        return "\n".join(text for (_, text), stays in zip(blocks, wanted, strict=True) if stays)
    # the same tokens as those of the suffixes: blocks hold single spaces only
    ends = np.cumsum([text.count(" ") + 1 for _, text in blocks])
    # how many covered parts begin at a token less those that end there
    change = np.zeros(int(ends[-1]) + 1, np.int32)
    change[covered] = 1
    change[np.asarray(covered) + how.depth] -= 1
    drop = np.cumsum(change)[:-1] > 0
    # a run must be longer to be no text of a main block
    edges = np.flatnonzero(np.diff(drop.view(np.int8), prepend=0, append=0))
    long = drop.copy()
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        long[lo:hi] = hi - lo >= how.main_depth
    kept = []
    for (kind, text), stays, begin, end in zip(blocks, wanted, np.append(0, ends[:-1]), ends, strict=True):
        if not stays:
            continue
        gone = (long if kind == "main" else drop)[begin:end]
        if gone.any():
            text = " ".join(w for w, x in zip(text.split(" "), gone.tolist(), strict=True) if not x)
        if text:
            kept.append(text)
    return "\n".join(kept)
