"""Main text of web pages: the best contiguous region when words score positive and tags negative."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas"}
SIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", *RAW}
BREAKS_NOTHING = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "button", "select", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CONTENT = {"article", "main"}
SIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup",
    "promo", "promotion", "related", "reply", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"\S+")
SPACES = re.compile(r"\s+")
FIT_PAGES = 2000  # labelled pages that weights are learned from, about


def signature(name: str, attributes: str) -> tuple[str, bool]:
    """``name.class`` of a tag, and whether its own name, class, id or role marks it as no main text."""
    side, classes = name in SIDE, ""
    if attributes:
        for key, *values in NAMED.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "class":
                classes = ".".join(sorted(value.split()))
            if key == "role":
                side |= value in SIDE_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                side = True
            elif key in ("class", "id") and name == "article":  # a comment or teaser; "category-social" is none
                side |= any(re.split(r"[^a-z0-9]+", word)[0] in SIDE_WORDS for word in value.split())
            elif key in ("class", "id") and name not in ("html", "body", "main"):
                side |= not SIDE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value))
    return (f"{name}.{classes}" if classes else name), side


def parse(page: str) -> list[tuple]:
    """The page as tokens ``(signature or None, text, in side element, in content element, block break)``.

    Text under an element that is no main text is marked; a content element under one is none. Unclosed elements
    end with their parents; a page header counts as main text only inside the content element.
    """
    tokens: list[tuple] = []
    stack: list[tuple[str, bool, bool]] = []  # name, side, content
    at = 0
    lower = None

    def text(piece: str) -> None:
        if piece:
            _, side, content = stack[-1] if stack else ("", False, False)
            tokens.append((None, piece, side, content, False))

    while match := TOKEN.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        slash, name, attributes = match.groups()
        if name is None:
            continue
        name = name.lower()
        _, side, content = stack[-1] if stack else ("", False, False)
        if slash:
            if any(name == entry[0] for entry in stack):
                while stack.pop()[0] != name:
                    pass
                if name in CONTENT:  # the end of a content element lies outside it
                    content = stack[-1][2] if stack else False
            tokens.append(("/" + name, "", side, content, name not in INLINE | BREAKS_NOTHING))
            continue
        if name in CLOSES_P and any(entry[0] == "p" for entry in stack) and "p" in [e[0] for e in stack[-8:]]:
            # A new block ends an open paragraph and what is open in it.
            depth = max(i for i, entry in enumerate(stack) if entry[0] == "p")
            if all(entry[0] in INLINE or entry[0] == "p" for entry in stack[depth:]):
                del stack[depth:]
                _, side, content = stack[-1] if stack else ("", False, False)
        sign, marked = signature(name, attributes)
        marked |= name == "header" and not content
        tokens.append((sign, "", side or marked, content, name not in INLINE | BREAKS_NOTHING))
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + name, at)
            at = len(page) if end < 0 else end
            stack.append((name, True, content))
        elif name not in VOID and not attributes.endswith("/"):
            stack.append((name, side or marked, content or name in CONTENT and not (side or marked)))
    text(page[at:])
    return tokens


def words_in(piece: str) -> int:
    return len(WORD.findall(piece))


def count_labelled(tokens: list[tuple]) -> Counter:
    """How often each tag, and words, stand inside and outside the content element of a labelled page.

    A page is labelled if it has an ``article`` or ``main`` element that is main text; others count nothing. Words
    of side elements are outside wherever they stand, tags are where they stand.
    """
    out: Counter = Counter()
    if any(token[3] for token in tokens):
        for sign, piece, side, content, _ in tokens:
            out[(sign or "#word", content and not (side and sign is None))] += 1 if sign else words_in(piece)
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weight of a tag: minus its log odds of standing outside main text, never above a small negative value.

    Words get their log odds of standing inside, at least 1. ``#tag`` is the weight of a tag never seen.
    """
    inside = sum(n for (s, i), n in counts.items() if i and s != "#word")
    outside = sum(n for (s, i), n in counts.items() if not i and s != "#word")
    signs = {s for s, _ in counts}
    spread = 0.5 * len(signs - {"#word"})  # half a count for every tag on each side
    out = {"#tag": -1.0}
    for sign in signs:
        a, b = counts.get((sign, True), 0), counts.get((sign, False), 0)
        if sign == "#word":
            out[sign] = max(1.0, math.log((a + 1) / (b + 1)))
        else:
            odds = math.log((b + 0.5) / (outside + spread)) - math.log((a + 0.5) / (inside + spread))
            out[sign] = -max(0.01, odds)
    out.setdefault("#word", 1.0)
    return out


def best_region(tokens: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """First and one past the last token of the region with the largest sum: a linear scan.

    Words under elements that are no main text score nothing; tags there cost their learned weight, unseen ones
    nothing.
    """
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    word, other = weights["#word"], weights["#tag"]
    for i, (sign, piece, side, _, _) in enumerate(tokens):
        if sign:
            total += weights.get(sign, 0.0 if side else other)
        elif not side:
            total += word * words_in(piece)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    return best_from, best_to


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, decoded, white space reduced, joined by an empty line."""
    tokens = parse(page or "")
    blocks, open_ = [], []
    start, stop = best_region(tokens, weights)

    def close() -> None:
        block = SPACES.sub(" ", html.unescape("".join(open_))).strip()
        if block:
            blocks.append(block)
        open_.clear()

    for sign, piece, side, _, breaks in tokens[start:stop]:
        if sign is None:
            if not side:
                open_.append(piece)
        elif breaks:
            close()
        elif sign in ("br", "wbr"):
            open_.append(" " if sign == "br" else "")
    close()
    return "\n\n".join(blocks)


def learn_weights(pages: DataFrame, rows: int = FIT_PAGES) -> dict[str, float]:
    """Weights from a bounded sample, about ``rows`` pages picked by a hash of page_id.

    Counts are summed by Spark; tags seen in fewer than three places are left to the weight of unseen ones, so
    that what reaches the driver is bounded by the sample.
    """
    total = pages.count()
    if not total:
        return weights_of({})
    picked = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < F.lit(float(rows) * (1 << 30) / total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for page in batch.column(0):
                sums.update(count_labelled(parse(page.as_py() or "")))
            yield pa.record_batch([
                pa.array([s for s, _ in sums], pa.string()), pa.array([i for _, i in sums], pa.bool_()), pa.array(list(sums.values()), pa.int64())
            ], names=["sign", "inside", "n"])

    summed = picked.select(F.col("html").cast("string").alias("html")).mapInArrow(count, "sign string, inside boolean, n long")
    frequent = summed.groupBy("sign", "inside").agg(F.sum("n").alias("n")).where("n > 2")
    return weights_of({(r.sign, r.inside): r.n for r in frequent.collect()})


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from its whole html.

    Null and empty pages, and pages without words, give an empty text. Content elements serve to learn the weights;
    the best region is found by these alone. Repeated rows stay, extra columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learn_weights(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(page.as_py(), shared.value) for page in part.column(2)]
                yield pa.record_batch([
                    part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
                ], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
