"""Main text of web pages by two-pass block rules.

A page is read as a stream of tags and text. Block tags cut it into blocks; each knows its
words, how many are stop words, how many characters stand in links, and which containers hold
it. Pass one decides what it can: blocks of navigation, footers and the like are boilerplate,
and so are blocks that are mostly link; long text with enough stop words is content (in a
script of which no stop words are listed, long text with few links). Short blocks, and long
ones with few stop words, stay ambiguous. In pass two these take the label of their nearest
decided neighbour.

A form, or a container whose class or id is named like boilerplate, is a doubtful one: it goes
only from a page that has content or an article elsewhere, or if it has no content itself. Where a page marks an
article that holds as much content as the rest, the rest goes, and the article's borders count
as content: what is ambiguous beside them is part of it. What links or densities decided against
inside an article stays out and draws the ambiguous blocks next to it along. Containers speak
for what they hold, not for their neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag names, and words in class, id and role that mark what is no article.
DROPPED = "script style noscript template textarea select button svg math iframe object canvas audio video head title"
SKIPPED = "nav header footer aside menu dialog search"
DOUBTFUL = "form fieldset"
ARTICLE = "article main"
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul"
VOID = "area base br col embed hr img input link meta param source track wbr"
#: A new one of these ends an open one: paragraphs and items may leave out their end tag.
SELF_ENDING = "p li dt dd td th tr option"
BOILERPLATE_WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices alert disclaimer comment comments respond replies disqus discussion related recommended share sharing "
    "social subscribe subscription newsletter signup login search pagination pager popup modal overlay widget toolbar"
)
#: Words beside those that make a class speak of the layout around an article.
LAYOUT_WORDS = "no has with without layout"
BOILERPLATE_ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar"
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with his they be at one have this from or had by not but what all were we when your can said there an which she do their if will up other about out many then them these so some her would make like him into time has",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man dem ich im",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou comme mais aux elle nous vous été ces ses leur cette être fait tout y on d l je",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy",
}

_sets = {k: frozenset(v.split()) for k, v in (("drop", DROPPED), ("skip", SKIPPED), ("doubt", DOUBTFUL), ("article", ARTICLE), ("block", BLOCKS), ("void", VOID), ("self", SELF_ENDING), ("role", BOILERPLATE_ROLES), ("word", BOILERPLATE_WORDS), ("layout", LAYOUT_WORDS))}
_stop = frozenset(w for v in STOP_WORDS.values() for w in v.split())

_marks = ".,;:!?()\"'#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Thresholds of pass one; lengths in characters, densities as shares."""

    content_chars: int = 70
    stop_density: float = 0.15
    #: Above it a block is mostly link.
    link_density: float = 0.5
    #: Above it long text with few stop words is boilerplate.
    some_links: float = 0.2
    #: In an article so many linked blocks in a row are a list of links.
    link_run: int = 3


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|title)\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<(?:!|\?|/?[a-zA-Z])[^>]*>",
    re.S | re.I,
)
_CLOSED = re.compile(r"(?:-->|/>|</[a-z]+\s*>|\A<(?!!--)[^>]*>)\Z", re.I)
_CUT_OFF = re.compile(r"<(?:!|\?|/?[a-zA-Z])[^>]*\Z")  # a tag cut off by the page's end
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_OTHER_SCRIPTS = re.compile("[\u0370-\u1dff\u2e80-\uffef\U00010000-\U0010ffff]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    skipped: bool = False
    doubtful: int = 0
    article: int = 0
    heading: bool = False
    label: str = ""
    text: str = ""


#: What a container's tag and attributes say of it.
_PLAIN, _BOILERPLATE, _DOUBTFUL = 0, 1, 2


def _mark_of(tag: str, attrs: str, in_article: bool) -> int:
    """A name counts as a whole word or as the last word of one: ``comments`` and
    ``post-comments``, but not ``comments-open``."""
    if tag in _sets["skip"]:
        # an article's own header holds its headline
        return _PLAIN if in_article and tag == "header" else _BOILERPLATE
    mark = _DOUBTFUL if tag in _sets["doubt"] else _PLAIN
    if "=" not in attrs and "hidden" not in attrs.lower():
        return mark
    if _HIDDEN.search(attrs):
        return _BOILERPLATE
    for name, a, b, c in _NAMES.findall(attrs):
        value = html.unescape(a or b or c).lower()
        if name.lower() == "role":
            if value.strip() in _sets["role"]:
                return _BOILERPLATE
        elif tag not in ("html", "body", "main"):
            for token in value.split():
                words = [w for w in _SPLIT.split(token) if w]
                if words and words[-1] in _sets["word"] and _sets["layout"].isdisjoint(words):
                    mark = _DOUBTFUL
    return mark


class _Open:
    """The open tags, with the places of each name and of blocks and articles, so that no
    end tag has to search them."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, int, int]] = []  # name, mark, article before it
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.articles: list[int] = []

    def push(self, tag: str, bad: int, article: int) -> None:
        at = len(self.tags)
        self.tags.append((tag, bad, article))
        self.places.setdefault(tag, []).append(at)
        if tag in _sets["block"]:
            self.blocks.append(at)
        if tag in _sets["article"]:
            self.articles.append(at)

    def pop(self) -> tuple[str, int, int]:
        tag, bad, article = self.tags.pop()
        self.places[tag].pop()
        if tag in _sets["block"]:
            self.blocks.pop()
        if tag in _sets["article"]:
            self.articles.pop()
        return tag, bad, article

    def place_of_end(self, tag: str) -> int | None:
        """Where the element that ``</tag>`` ends began; inline tags don't reach out of an article."""
        at = self.places.get(tag)
        if not at or (tag not in _sets["block"] and self.articles and self.articles[-1] > at[-1]):
            return None
        return at[-1]

    def place_ended_by(self, tag: str) -> int | None:
        """Where the paragraph or item began that a new block ``tag`` ends without an end tag."""
        if not self.blocks:
            return None
        name = self.tags[self.blocks[-1]][0]
        return self.blocks[-1] if name == "p" or (name == tag and tag in _sets["self"]) else None


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order. Takes time in proportion to the page's length."""
    out: list[Block] = []
    tags = _Open()
    skipping, article, articles, links, here = 0, 0, 0, 0, None
    doubts, doubtful = 0, 0  # open doubtful containers, and the number of the outermost one
    heading = False

    def close(at: int) -> None:
        nonlocal skipping, article, links, heading, doubts
        while len(tags.tags) > at:
            name, bad, article = tags.pop()
            skipping -= bad == _BOILERPLATE
            doubts -= bad == _DOUBTFUL
            links -= name == "a"
            if name in _HEADINGS:
                heading = False

    def text(raw: str) -> None:
        nonlocal here
        if here is None:
            here = Block(skipped=skipping > 0, doubtful=doubtful if doubts else 0, article=article, heading=heading)
            out.append(here)
        here.parts.append(raw)
        if links:
            here.linked += len(raw)

    at, end = 0, page.rfind(">") + 1  # no tag ends after that
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() in ("title", "textarea"):
                here = None
            if at == end and not _CLOSED.search(m[0]):
                at = len(page)  # a comment or script that never ends takes the rest
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        block = tag in _sets["block"]
        if block:
            here = None
        if m["end"]:
            if (place := tags.place_of_end(tag)) is not None:
                close(place)
            continue
        if tag in _sets["void"]:
            continue
        if block and (place := tags.place_ended_by(tag)) is not None:
            close(place)
        attrs = m["attr"] or ""
        bad = _BOILERPLATE if tag in _sets["drop"] else _mark_of(tag, attrs, article > 0)
        tags.push(tag, bad, article)
        skipping += bad == _BOILERPLATE
        doubtful += bad == _DOUBTFUL and not doubts
        doubts += bad == _DOUBTFUL
        links += tag == "a"
        heading = heading or tag in _HEADINGS
        if tag in _sets["article"] and not skipping and not article:
            articles += 1
            article = articles
    if at < len(page):
        tail = page[at:]
        cut = _CUT_OFF.search(tail)
        text(tail[: cut.start()] if cut else tail)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(_marks) in _stop for w in words) / len(words)


def listed_script(text: str) -> bool:
    """Not most of the text is in scripts other than Latin, for which stop words are listed."""
    return text.isascii() or 2 * sum(map(len, _OTHER_SCRIPTS.findall(text))) <= len(text)


def is_content(b: Block, rules: Rules) -> bool:
    """Long text with few links, and enough stop words if its script has any listed."""
    share = b.linked / len(b.text)
    if len(b.text) < rules.content_chars or share > rules.link_density:
        return False
    return stop_density(b.text) >= rules.stop_density if listed_script(b.text) else share <= rules.some_links


def first_pass(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Label blocks ``good``, ``bad`` or ``unsure``; ``out`` for those of boilerplate containers
    and, where the page marks an article with as much content as the rest, for those outside."""
    good = [not b.skipped and is_content(b, rules) for b in blocks]
    kept = set()  # doubtful containers that the page can't do without
    if not any((g or b.article) and not b.skipped and not b.doubtful for g, b in zip(good, blocks)):
        kept = {b.doubtful for g, b in zip(good, blocks) if g}
    out = [b.skipped or (b.doubtful > 0 and b.doubtful not in kept) for b in blocks]
    inside = sum(len(b.text) for g, o, b in zip(good, out, blocks) if g and not o and b.article)
    outside = sum(len(b.text) for g, o, b in zip(good, out, blocks) if g and not o and not b.article)
    marked = inside >= outside and any(b.article and not o for o, b in zip(out, blocks))
    run = 0
    for k, b in enumerate(blocks):
        if not marked:
            b.article = 0
        long = len(b.text) >= rules.content_chars
        share = b.linked / len(b.text)
        if out[k] or (marked and not b.article):
            b.label, run = "out", 0
            continue
        mostly = share > rules.link_density
        run = run + 1 if mostly else 0
        if mostly:
            b.label = "unsure" if b.heading or (b.article and not long) else "bad"
            if run >= rules.link_run:
                for c in blocks[k + 1 - run : k + 1]:
                    c.label = "bad"
        elif good[k]:
            b.label = "good"
        else:
            b.label = "bad" if long and share > rules.some_links else "unsure"


def second_pass(labels: list[str], headings: list[bool], article: bool) -> list[str]:
    """Labels of one article, or of a page without any, with ``unsure`` decided.

    The nearest decided neighbour decides. As far before as after: a heading goes with what
    follows, other blocks are content if one of the two is. An article's borders are
    content; on a page without a decided block everything is.
    """
    edge = "good" if article else ""

    def seen(order) -> dict[int, tuple[str, float]]:
        label, far, out = edge, 0 if edge else float("inf"), {}
        for i in order:
            far += 1
            out[i] = (label, far)
            if labels[i] != "unsure":
                label, far = labels[i], 0
        return out

    before, after = seen(range(len(labels))), seen(reversed(range(len(labels))))
    out = []
    for i, x in enumerate(labels):
        if x == "unsure":
            (a, near_a), (b, near_b) = before[i], after[i]
            if near_a != near_b and a and b:
                x = a if near_a < near_b else b
            elif a and b:
                x = b if headings[i] and not (article and i == 0) else "good" if "good" in (a, b) else "bad"
            else:
                x = a or b or "good"
        out.append(x)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Blocks of content, joined by one blank; empty for null or nothing but boilerplate."""
    if not page:
        return ""
    blocks = blocks_of(page)
    first_pass(blocks, rules)
    groups: dict[int, list[Block]] = {}
    for b in blocks:
        if b.label != "out":
            groups.setdefault(b.article, []).append(b)
    for article, group in groups.items():
        for b, label in zip(group, second_pass([b.label for b in group], [b.heading for b in group], article > 0)):
            b.label = label
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of every row of ``pages``.

    Null and empty pages, and pages without content, give an empty text. Markup may be cut
    off or unbalanced anywhere; a page takes time in proportion to its length. Null and
    repeated ids and repeated rows come back as often as given; other columns are not read;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
