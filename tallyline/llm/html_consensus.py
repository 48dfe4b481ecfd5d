"""Main text of web pages by consensus of their hosts.

Pages of a host share a layout. What a tag, a role, a class or an id marks as navigation,
notice, comments and the like is never text. Of the rest, each page's containers are scored
by the characters they hold outside links less those inside links; the best one, the
innermost of equals, gets the page's vote for its path, generalised to tags and classes
with digits masked. Spark counts the votes per host; the pages are then read again, and
their text is what the elements at the winning path hold: what the host's pages agree on
decides what belongs to the text, also where a page by itself would say otherwise. Only a
page of another template, with less than half of its text there, goes by its own best
container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyline.llm.common import field, written

#: The table of winners is broadcast up to this many hosts.
MAX_BROADCAST_HOSTS = 100_000
#: Levels of nesting that are told apart; deeper elements count as children of the last.
MAX_DEPTH = 200

# Names from the HTML standard, and words that mark what isn't main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - frozenset("br html body".split())
_CONTAINERS = frozenset("article body div main section td".split())
_NOT_TEXT = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title".split()
)
_NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert alerts banner banners "
    "breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr "
    "masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination "
    "popup popups promo promos promoted promotion recommended related replies reply respond share "
    "sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar".split()
)
#: Of these, words for what readers write.
_COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
#: Words for noise that also stand for a topic behind a word that isn't about layout.
_TOPICS = frozenset("share promotion notice notices related social alert alerts".split())
#: Words for the text itself, for parts of a page, and for what is around several of them.
_CONTENT_WORDS = frozenset("article body content entry main page post posts site story text".split())
_PART_WORDS = frozenset(
    "area bar block box button buttons count form group holder inner item items link links list panel "
    "region row section thread title tools top bottom left right col column".split()
)
_AROUND_WORDS = frozenset("wrap wrapper layout container outer grid".split())
_NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split()
)
_WHOLE = frozenset("html body main article".split())
_TELLING = frozenset("has have no with without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source:
        for name, *values in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def _noise(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the tag or role says that this isn't main text."""
    if tag in _WHOLE:
        return False
    if tag in _NOT_TEXT or (tag == "header" and not inside_article):
        return True
    return attributes.get("role", "").lower() in _NOISE_ROLES


def _noisy_words(words: list[str]) -> bool:
    """Whether the words of a class or id name what isn't main text.

    A compound is about its first word or, without words for parts, its last one. What is
    around parts ("content-sidebar-wrap") has the text in it if it names that, too.
    """
    head = list(words)
    while len(head) > 1 and (head[-1] in _PART_WORDS or head[-1] in _AROUND_WORDS or head[-1].isdigit()):
        head.pop()
    if not head or words[-1] in _AROUND_WORDS and _CONTENT_WORDS.intersection(words):
        return False
    if head[0] in _NOISE_WORDS:
        return True
    known = _NOISE_WORDS | _CONTENT_WORDS | _PART_WORDS
    return head[-1] in _NOISE_WORDS and (head[-1] not in _TOPICS or all(w in known for w in head[:-1]))


def _noise_name(tag: str, attributes: dict[str, str]) -> int:
    """2 if a class or id names comments, 1 if other noise, else 0.

    What follows "with", "no" or the like tells of something around the text or missing.
    A heading's id is made of its text.
    """
    if tag in _WHOLE:
        return 0
    names = attributes.get("class", "").split()
    if tag not in _HEADINGS:
        names += attributes.get("id", "").split()
    found = 0
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        told = next((i for i, w in enumerate(words) if w in _TELLING), len(words))
        if told and _noisy_words(words[:told]):
            found = max(found, 2 if _COMMENT_WORDS.intersection(words[:told]) else 1)
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """The text of a page by container: ``blocks`` are (container, in links, text)."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        #: text of one block each, with the innermost container it is in
        self.blocks: list[tuple[int, int, str]] = []
        #: blocks as read: container, and pieces (what _noise_name says around it, in a link, text)
        self._raw: list[tuple[int, list[tuple[int, bool, str]]]] = []
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        # an open element: tag, container, noisy, in article, path, noise by its name
        stack = [("", 0, False, False, "", 0)]
        pieces: list[tuple[int, bool, str]] = []
        holder, links_open = 0, 0

        def close_block() -> None:
            nonlocal pieces
            if pieces:
                self._raw.append((holder, pieces))
                pieces = []

        def put(raw: str) -> None:
            nonlocal holder
            _, container, noisy, _, _, named = stack[-1]
            if not raw or noisy or named == 2:
                return
            if container != holder:
                close_block()
                holder = container
            pieces.append((named, links_open > 0, html.unescape(raw) if "&" in raw else raw))

        at, size = 0, len(source)
        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                put(source[at:])
                break
            put(source[at:mark])
            nxt = source[mark + 1 : mark + 2]
            if nxt in ("!", "?"):
                if source.startswith("<!--", mark):
                    end = source.find("-->", mark + 4)
                    at = size if end < 0 else end + 3
                else:
                    end = source.find(">", mark)
                    at = size if end < 0 else end + 1
                continue
            if not (nxt.isalpha() or nxt == "/"):
                put("<")
                at = mark + 1
                continue
            m = _TAG.match(source, mark) or _LOOSE_TAG.match(source, mark)
            if m is None:  # a closing mark without a name, or a tag that the page's end cuts off
                end = source.find(">", mark)
                at = size if end < 0 else end + 1
                continue
            at = m.end()
            closing, tag = m[1], m[2].lower()
            if tag in _BLOCKS:
                close_block()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        links_open -= sum(e[0] == "a" for e in stack[depth:])
                        del stack[depth:]
                        break
                continue
            if tag in _CLOSES_P or tag == "li":
                self._imply(stack, tag)
                links_open = sum(e[0] == "a" for e in stack) if links_open else 0
            if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            attributes = _attributes(m[3])
            _, container, noisy, in_article, path, named = stack[-1]
            noisy = noisy or _noise(tag, attributes, in_article)
            if not noisy and attributes:
                named = max(named, _noise_name(tag, attributes))
            if not noisy and len(stack) < MAX_DEPTH and tag != "html":
                path = f"{path}>{_step(tag, attributes)}" if tag in _CONTAINERS else path
                if tag in _CONTAINERS and not in_article:
                    self.paths.append(path)
                    self.parents.append(container)
                    container = len(self.paths) - 1
            if tag in _RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                if not noisy:
                    put(source[at : end.start() if end else size])
                at = end.start() if end else size
                if not end:
                    continue
            links_open += tag == "a"
            stack.append((tag, container, noisy, in_article or tag in ("article", "main"), path, named))
        close_block()

    def _settle(self) -> None:
        """Make blocks of what was read, without the elements that are noise by their name.

        Where that leaves nothing, the layout uses such names for its text: then what they
        hold counts, comments apart.
        """
        for most in (0, 1):
            for holder, pieces in self._raw:
                kept = [p for p in pieces if p[0] <= most]
                if text := " ".join("".join(p[2] for p in kept).split()):
                    linked = sum(len(p[2]) for p in kept if p[1])
                    self.blocks.append((holder, min(linked, len(text)), text))
            if any(2 * linked < len(text) for _, linked, text in self.blocks):
                break
            self.blocks.clear()
        self._raw.clear()

    @staticmethod
    def _imply(stack: list[tuple], tag: str) -> None:
        """Close what an opening block ends: a paragraph, or the list item before it."""
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = stack[depth][0]
            if open_tag == "p" or (tag == "li" and open_tag == "li"):
                del stack[depth:]
                return
            if open_tag in _BLOCKS or open_tag in ("ul", "ol"):
                return

    def scores(self) -> list[int]:
        """Of each container: characters outside links that it holds, less those in links."""
        found = [0] * len(self.paths)
        for container, linked, text in self.blocks:
            found[container] += len(text) - 2 * linked
        for i in range(len(found) - 1, 0, -1):  # parents come before what they hold
            found[self.parents[i]] += found[i]
        return found

    def best(self) -> int:
        """The container with the highest score, of equals the last one opened."""
        scores = self.scores()
        return max(range(len(scores)), key=lambda i: (scores[i], i))

    def vote(self) -> str | None:
        """The path of the best container; none for a page without text."""
        return self.paths[self.best()] if self.blocks else None

    def text(self, path: str | None) -> str:
        """Text of the elements at ``path``, or of the page's own best container.

        Inside, blocks that are mostly links count where their container isn't.
        """
        inside = self._inside({i for i, p in enumerate(self.paths) if p == path} if path is not None else set())
        good = [(c, len(text) - linked) for c, linked, text in self.blocks]
        if 2 * sum(n for c, n in good if inside[c]) < max(1, sum(n for _, n in good)):
            inside = self._inside({self.best()})
        own: dict[int, int] = {}
        for container, linked, text in self.blocks:
            own[container] = own.get(container, 0) + len(text) - 2 * linked
        kept = (t for c, linked, t in self.blocks if inside[c] and (2 * linked < len(t) or own[c] > 0))
        return "\n".join(kept)

    def _inside(self, wanted: set[int]) -> list[bool]:
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = i in wanted or (parent >= 0 and inside[parent])
        return inside


def host_of(url: Column) -> Column:
    """Host and port of a URL in lower case; empty where there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host's pages, the first of equals."""
    schema = StructType([StructField(c, StringType()) for c in ("host", "path")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                votes = [Page(source or "").vote() for source in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string())], names=schema.names)

    cast = pages.select(
        host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")
    ).mapInArrow(run, schema)
    counted = cast.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))
    ranked = counted.select("host", F.struct(-F.col("votes"), "path").alias("place"))
    return ranked.groupBy("host").agg(F.min("place").alias("place")).select("host", "place.path")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Main text of every page: (id, url, text, n_chars), one row per input row.

    Character references are decoded; white space inside a block becomes one space;
    blocks are joined in page order by one line break. Null and empty pages, and pages
    without main text, give an empty text. Pages without a host, or with a null URL,
    vote as one host. Repeated rows stay and vote repeatedly; ties go to the first path
    in order of code points; an empty table gives an empty result; other columns are ignored.
    A page is read whole, however long, by one task; it needs a few times its size.
    """
    winners = written(host_paths(pages, url_col, html_col), "host-paths")
    if winners.count() <= MAX_BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    found = pages.select(
        F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("__html"), host_of(F.col(url_col)).alias("host")
    ).join(winners, "host", "left")
    schema = StructType(
        [field(pages, id_col), field(pages, url_col), StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [
                    Page(source or "").text(path)
                    for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                ]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
                columns.append(pa.array([len(t) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.select("__id", "__url", "__html", "path").mapInArrow(run, schema)
