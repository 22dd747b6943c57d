"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores ``2 p - 1``, where p is the share of words
in its kind of place (the nearest block element, or any boilerplate element around it) that
labelled pages have inside their article; a tag scores ``-TAG_COST`` times the share of such tags
that lie outside. So words count for a region and tags against it, as far as the labelled pages
say so. One linear scan finds the contiguous region with the largest sum. Inside it, what stands
in a boilerplate element (navigation, adverts, forms, comments and the like) is left out.

Labelled pages are those that mark their article with an ``article`` element; the weights come from
a bounded sample of them (``SAMPLE`` pages of at most ``MAX_TRAINING_CHARS`` characters) and from
``KNOWN`` shares, worth ``PRIOR_WEIGHT`` observations, for elements that pages rarely show. The
element itself is not among what is scored.

Blocks are the runs of text between block-level tags. In a block, character references are
decoded, white space (line breaks included) becomes one space, ends are trimmed; blocks are joined
in page order by two line ends. Nothing is dropped or cut besides. Comments, scripts, styles and
the head are markup; a tag that the page's end cuts off is too.

Null or empty html, and pages without a positive region, give the empty string. Repeated rows are
extracted alike, other columns of the input are ignored, and an empty table gives an empty result.
"""

import html
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, training_ids

SAMPLE = 2_000
MAX_TRAINING_CHARS = 100_000
MOST_FEATURES = 2_000
TAG_COST = 3.25
PRIOR_WEIGHT = 20.0

# Element names of HTML by the part they play.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog button select fieldset".split())
# Words that mark boilerplate in class, id and role attributes.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo promoted promotion related replies reply search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADER_WORDS = frozenset(["header", "masthead", "banner"])
# Share of words inside the article to start from, by place; other blocks start from one half.
KNOWN = {"boilerplate": 0.01, "p": 0.8, "h1": 0.8, "h2": 0.7, "h3": 0.7, "blockquote": 0.8, "pre": 0.7, "li": 0.4, "body": 0.2}
# Tags that articles are made of, and the share of them inside to start from; other tags start from one half.
ARTICLE_TAGS = frozenset("p br b i em strong h1 h2 h3 h4 h5 h6 blockquote".split())
ARTICLE_TAG_SHARE = 0.95

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def known_tag(name: str) -> float:
    """Share of a tag inside articles to start from."""
    return ARTICLE_TAG_SHARE if name in ARTICLE_TAGS else 0.5


@dataclass(frozen=True)
class Weights:
    """Score of a word by its place and of a tag by its name."""

    words: dict[str, float]
    tags: dict[str, float]

    def word(self, place: str) -> float:
        return self.words.get(place, 2 * KNOWN.get(place, 0.5) - 1)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -TAG_COST * (1 - known_tag(name)))


@dataclass(frozen=True)
class Piece:
    """A run of text, or a tag (``text`` is None)."""

    text: str | None
    name: str  # place of the text or name of the tag
    boilerplate: bool
    article: bool
    breaks: bool


@dataclass(frozen=True)
class _Open:
    name: str
    place: str
    boilerplate: bool
    article: bool


def _is_boilerplate(name: str, attributes: str, inside_article: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    words = {w for m in _ATTRIBUTE.finditer(attributes) for w in _PARTS.findall((m[1] or m[2] or m[3] or "").lower())}
    return bool(words & (BOILERPLATE_WORDS - HEADER_WORDS if inside_article else BOILERPLATE_WORDS))


def pieces_of(page: str) -> list[Piece]:
    """Texts and tags of a page in order, each with where it stands."""
    out: list[Piece] = []
    top = _Open("", "body", False, False)
    stack: list[_Open] = []
    opened: dict[str, int] = {}
    at = 0

    def text(until: int) -> None:
        if until > at and (run := page[at:until]).strip():
            out.append(Piece(run, "boilerplate" if top.boilerplate else top.place, top.boilerplate, top.article, False))
        elif until > at:
            out.append(Piece(" ", "", top.boilerplate, top.article, False))

    def close(name: str) -> None:
        nonlocal top
        while stack:
            gone = stack.pop()
            opened[gone.name] -= 1
            if gone.name == name:
                break
        top = stack[-1] if stack else _Open("", "body", False, False)

    while found := _TOKEN.search(page, at):
        text(found.start())
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        ends, block = bool(found[1] or found[4]), name in BLOCKS
        if not ends and name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if ends:
            if opened.get(name):
                close(name)
        elif block and name != "p" and name != "li" and opened.get("p") and top.place == "p":
            close("p")
        elif name in ("p", "li", "td", "tr", "dd", "dt", "option") and opened.get(name) and top.place == name:
            close(name)
        out.append(Piece(None, name, top.boilerplate, top.article, block))
        if name == "br":
            out.append(Piece(" ", "", top.boilerplate, top.article, False))
        if not ends and name not in VOID:
            inside = top.article or name == "article"
            top = _Open(
                name,
                name if block else top.place,
                top.boilerplate or _is_boilerplate(name, found[3] or found[6] or "", inside or bool(opened.get("main"))),
                inside,
            )
            stack.append(top)
            opened[name] = opened.get(name, 0) + 1
    text(len(page))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; the first and shortest of equals."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def score_pieces(pieces: list[Piece], weights: Weights) -> list[float]:
    """Score of each piece; a run of text counts once for each of its words."""
    return [
        weights.tag(p.name) if p.text is None else len(p.text.split()) * weights.word(p.name) for p in pieces
    ]


def extract(page: str | None, weights: Weights) -> str:
    """Main text of one page."""
    if not page:
        return ""
    pieces = pieces_of(page)
    start, end = best_region(score_pieces(pieces, weights))
    blocks, runs = [], []
    for piece in [*pieces[start:end], Piece(None, "", False, False, True)]:
        if piece.breaks:
            if block := " ".join("".join(runs).split()):
                blocks.append(block)
            runs = []
        elif piece.text is not None and not piece.boilerplate:
            runs.append(html.unescape(piece.text))
    return "\n\n".join(blocks)


def _counts(batches):
    """Words and tags inside and outside the articles of a batch of pages, by feature."""
    for batch in batches:
        seen: dict[tuple[bool, str], list[int]] = {}
        for page in batch["html"]:
            for piece in pieces_of(page):
                if piece.text is None and piece.name in ("article", "main"):
                    continue
                many = 1 if piece.text is None else len(piece.text.split())
                if many:
                    seen.setdefault((piece.text is None, piece.name), [0, 0])[piece.article] += many
        yield pd.DataFrame(
            [(tag, name, n[1], n[0]) for (tag, name), n in seen.items()], columns=["tag", "name", "inside", "outside"]
        ).astype({"tag": bool, "name": str, "inside": "int64", "outside": "int64"})


def fit(pages: DataFrame) -> Weights:
    """Weights from a bounded sample of the ``pages`` (page_id, html) that mark their article.

    Pages of at most ``MAX_TRAINING_CHARS`` come first, longer ones teach by so many characters where there
    are too few. The ``MOST_FEATURES`` names that occur most have weights, others their prior ones.
    """
    marked = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")).filter(
        F.col("page_id").isNotNull() & F.col("html").rlike("(?i)<article[\\s>]")
    )
    known = marked.select("doc_id", F.lit(1).alias("one")).distinct()
    chosen = training_ids(marked, known, "one", SAMPLE, MAX_TRAINING_CHARS).select("doc_id")
    whole = marked.withColumn("html", F.left("text", F.lit(MAX_TRAINING_CHARS))).drop("text")
    sample = whole.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("html").alias("html"))
    counts = (
        sample.mapInPandas(_counts, "tag boolean, name string, inside bigint, outside bigint")
        .groupBy("tag", "name")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "tag", "name")
        .limit(MOST_FEATURES)
        .collect()
    )
    words, tags = {}, {}
    for tag, name, inside, outside in counts:
        prior = known_tag(name) if tag else KNOWN.get(name, 0.5)
        share = (inside + PRIOR_WEIGHT * prior) / (inside + outside + PRIOR_WEIGHT)
        if tag:
            tags[name] = -TAG_COST * (1 - share)
        else:
            words[name] = 2 * share - 1
    return Weights(words, tags)


def main_text(page: Column, weights: Weights, spark) -> Column:
    """Main text of every page."""
    sent = spark.sparkContext.broadcast(weights)

    def make():
        own = sent.value

        def apply(batch: pa.Array) -> pa.Array:
            return pa.array([extract(p.as_py(), own) for p in batch], pa.string())

        return apply

    return arrow_column(make, "string")(page)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    weights = weights or fit(pages)
    found = pages.select("page_id", "url", main_text(F.col("html"), weights, pages.sparkSession).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
