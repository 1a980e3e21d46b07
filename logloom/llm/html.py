"""Main text of web pages by container paths that the pages of a host agree on."""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import blocks, tidy
from logloom.session import written_once
from logloom.sizing import is_small

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINER = frozenset("article body center dd details div li main section td blockquote".split())
#: Never part of an article.
OUTSIDE = frozenset(
    "head nav aside footer form script style noscript template iframe button select option textarea svg canvas object "
    "dialog menu audio video label input title".split()
)
#: Words of a class, id or role that mark the same.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies discussion disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget widgets".split()
)
#: With one of these, a header is the article's own.
TITLE_WORDS = frozenset("article entry post story".split())
#: Hosts whose winners, 20 paths each at most, are copied to every task; pages of a host that meet its winners in one task.
HOSTS, PAGES = 10_000, 20_000
#: A path wins if at least this share of its host's pages votes for it, so a host has 20 winners at most.
WIN = 0.05


class Node:
    """An open element and what it knows of those around it, so that no tag walks the stack."""

    __slots__ = ("label", "path", "out", "parent", "score", "inside", "holder", "container", "cuts", "under")

    def __init__(self, tag: str, label: str, path: int, out: bool, parent: Node | None):
        self.label, self.path, self.out, self.parent, self.score = label, path, out, parent, 0.0
        own_block, own_container = tag in BLOCK, tag in CONTAINER and not out
        self.inside = parent is not None and parent.inside or tag in ("article", "main")
        #: The nearest element, itself included, that text blocks end with.
        self.holder = self if parent is None or own_block or out else parent.holder
        self.container = self if own_container else parent and parent.container
        #: The lowest open element of each kind, since the last container, that a next block may close.
        self.cuts: dict[str, int] = {} if parent is None or own_container or tag in CONTAINER or out else parent.cuts
        self.under = False


def _marks(attributes: str) -> tuple[str, set[str], bool]:
    """The generalised class (digits as one sign, names in order), the words of class, id and role, and whether it is hidden."""
    name, words, hidden = "", set(), False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "class":
            name = ".".join(sorted({re.sub(r"[\d/]+", "#", x) for x in value.split()}))
        if key in ("class", "id", "role"):
            words.update(WORD.findall(value))
        hidden |= key == "style" and "display:none" in value.replace(" ", "") or (key, value) == ("aria-hidden", "true")
    hidden |= re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None
    return name, words, hidden


class Page:
    """Text blocks with the element they lie in, in page order, all containers, all elements, and the paths by number.

    Tolerates what browsers do: missing end tags, stray end tags, text cut off
    anywhere. An open paragraph ends at the next block element. Time and memory
    follow the length of the page, however deep it is nested.
    """

    def __init__(self, page: str):
        top = Node("", "", 0, False, None)
        self.nodes, self.found, self.containers = [top], [], []
        self.paths: dict[tuple[int, str], int] = {}
        self._stack, self._tags, self._open, self._held = [top], [""], {}, []
        self._read(page)

    def _close_block(self) -> None:
        if self._held:
            text = " ".join(references.unescape("".join(self._held)).split())
            self._held.clear()
            if text:
                self.found.append((self._stack[-1].holder, text))

    def _drop(self, at: int) -> None:
        for tag in self._tags[at:]:
            self._open[tag] -= 1
        del self._stack[at:], self._tags[at:]

    def _read(self, page: str) -> None:
        at, stack, tags, open_ = 0, self._stack, self._tags, self._open
        while at < len(page):
            m = TOKEN.search(page, at)
            upto = m.start() if m else len(page)
            if upto > at and not stack[-1].out:
                self._held.append(page[at:upto])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if open_.get(tag):
                    low = len(tags) - 1
                    while tags[low] != tag:
                        low -= 1
                    if any(t in BLOCK or n.out for t, n in zip(tags[low:], stack[low:])):
                        self._close_block()
                    self._drop(low)
                continue
            if tag == "br" or tag == "wbr":
                self._held.append(" " if tag == "br" else "")
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            self._begin(tag, m[3] or m[6] or "")
        if not stack[-1].out:
            self._close_block()

    def _begin(self, tag: str, attributes: str) -> None:
        stack, tags, open_ = self._stack, self._tags, self._open
        if tag in BLOCK:
            self._close_block()
            cuts = stack[-1].cuts
            low = min((cuts[t] for t in ("p", tag) if t in cuts and (t == "p" or t in ("dt", "th", "tr"))), default=None)
            if low is not None:
                self._drop(low)
            if tag == tags[-1] == "li" or tag in ("td", "th") and tags[-1] in ("td", "th"):
                self._drop(len(tags) - 1)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        parent = stack[-1]
        name, words, hidden = _marks(attributes) if attributes else ("", frozenset(), False)
        marked = tag in OUTSIDE or hidden
        marked |= tag not in ("html", "body", "article", "main") and not words.isdisjoint(OUTSIDE_WORDS)
        # A header inside the article holds its title.
        marked |= (tag == "header" or "header" in words and words.isdisjoint(TITLE_WORDS)) and not parent.inside
        if tag == "body" and open_.get("body") or tag == "html" and len(stack) > 1:
            return
        label = tag + (f".{name}" if name else "") if tag in BLOCK else ""
        path = self.paths.setdefault((parent.path, label), len(self.paths) + 1) if label else parent.path
        out = parent.out or marked
        if out and not parent.out and (tag in BLOCK or tag in OUTSIDE):
            self._close_block()
        node = Node(tag, label, path, out, parent)
        if tag in ("p", "dt", "th", "tr") and tag not in node.cuts:
            node.cuts = {**node.cuts, tag: len(stack)}
        stack.append(node)
        tags.append(tag)
        open_[tag] = open_.get(tag, 0) + 1
        self.nodes.append(node)
        if tag in CONTAINER and not out:
            self.containers.append(node)

    def best(self) -> tuple[str, float] | None:
        """The path of the best container and its weight, or None without text.

        A block gives its characters to the container it lies in and, from there
        up, half to each next one, so that the innermost element holding most of
        the prose wins over its wrappers and over a single paragraph. What is
        less than a double can add is not passed on.
        """
        for node, text in self.found:
            share, up, least = float(len(text)), node.container, len(text) * 2.0**-70
            while up is not None and share > least:
                up.score += share
                share /= 2
                up = up.parent and up.parent.container
        best = max(self.containers, key=lambda n: n.score, default=None)
        if best is None or not best.score:
            return None
        labels, up = [], best
        while up is not None:
            if up.label:
                labels.append(up.label)
            up = up.parent
        return "".join(f"/{x}" for x in reversed(labels)), math.log2(1 + best.score)

    def texts(self, path: str) -> list[str]:
        """The blocks under elements of a path."""
        number = 0
        for label in path.split("/")[1:]:
            number = self.paths.get((number, label))
            if number is None:
                return []
        for node in self.nodes:
            node.under = node.path == number or node.parent is not None and node.parent.under
        return [text for node, text in self.found if node.under]


def votes(page: str) -> tuple[str, float] | None:
    """The path that a page votes for and the weight of its vote."""
    return Page(page).best()


def extract(page: str, winners: list[str] | None) -> str:
    """The blocks under the first winning path that the page has text for; without one under its own best path."""
    read = Page(page)
    for path in winners or ():
        if texts := read.texts(path):
            return "\n\n".join(texts)
    own = read.best()
    return "\n\n".join(read.texts(own[0]) if own else [text for _, text in read.found])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    1. Each page scores its containers and votes for the path of the best one:
       the tags from the root with their classes, digits generalised.
    2. Votes are summed per host and path (partial sums first, so a host with a
       third of all pages is no hot spot); paths with enough of their host's
       votes win, 20 per host at most.
    3. Every page is extracted again from the winning path it has. The votes
       are written once. Winners of up to ``HOSTS`` hosts are copied to the
       tasks, so that no page moves; those of more meet the pages by host, a
       host's pages dealt over as many salts as their number asks for.

    Null or empty html gives an empty text. Pages without a host (null or odd
    url) vote together under the empty host. Repeated rows keep their rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            hosts, all_votes = block.column("host").to_pylist(), map(votes, (x or "" for x in block.column("html").to_pylist()))
            kept = [(h, *v) for h, v in zip(hosts, all_votes) if v]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("host", "path", "weight"), x)) for x in kept],
                pa.schema([("host", pa.string()), ("path", pa.string()), ("weight", pa.float64())]),
            )

    cast = written_once(
        rows.select("host", "html").mapInArrow(tidy(vote), "host string, path string, weight double")
        .groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight")),
        "votes",
    )
    total = cast.groupBy("host").agg(F.sum("n").alias("all"))
    winners = (
        cast.join(total, "host").where(F.col("n") >= WIN * F.col("all")).groupBy("host", "all")
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), -F.col("weight"), "path"))).alias("w"))
        .select("host", F.col("w.path").alias("winners"), "all")
    )
    winners = written_once(winners, "winners")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [
                extract(x or "", w)
                for x, w in zip(block.column("html").to_pylist(), block.column("winners").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("page_id").cast(pa.int64()), block.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    if is_small(winners, HOSTS):
        met = rows.join(F.broadcast(winners.drop("all")), "host", "left")
    else:
        # Hosts of more than PAGES pages are few; their winners are repeated for every salt.
        salts = F.ceil(F.col("all") / F.lit(PAGES)).cast("int")
        large = winners.where(salts > 1).select("host", salts.alias("salts"))
        place = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")
        dealt = rows.join(large, "host", "left").withColumn("salt", place)
        spread = winners.select("host", "winners", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        met = dealt.join(spread, ["host", "salt"], "left")
    return (
        met.select("page_id", "url", "html", "winners")
        .mapInArrow(tidy(take), "page_id long, url string, text string, n_chars long")
    )
