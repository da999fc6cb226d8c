"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags. A word's score is the sum of two pieces of evidence: where it stands (the kind of
container that element names, roles and class names suggest, or none) and what it stands in (a link, a list, a short or
long block, a block that ends like a sentence). Tags score by their name and container and never above zero. A linear
scan finds the contiguous region of the highest sum; if one article or container holds all of it, its short first and
last blocks belong to it too. Where the region goes on at both sides of a container whose own words and tags sum to zero or
less (an advert between paragraphs), that container is left out; where the region ends is the scan's decision.

A name costs a word more than its sentence gains, so what a name calls boilerplate is not content as long as the page has
other content. If the best region is worth less than ENOUGH and lies in no article, the names may be wrong (a form
around the whole page, an obituary called a notice): the scan runs without the names' losses, the containers that hold
most of the region it finds are released from their names, but for footers, readers' comments and what is not shown,
and the page is scanned again. Boilerplate in sentences that neither names, tags nor links tell from text (readers'
comments in an unnamed container) can't be told from it here.

The weights are log odds of lying inside the content, counted over labelled pages: pages whose author marked one
article. The mark itself is hidden from the contexts, so that the weights hold for pages without one. Counts are
summed over about TRAIN_PAGES pages (a documented bound, by the hash of page_id over the whole table) and added to
PRIOR pseudo-counts, so that contexts no labelled page shows have a weight too.

A page takes time in proportion to its length, however deep its elements are nested and however many are left open.

Defined cases: a null or empty page, or one without words, gives the empty text. Unclosed elements run to the end of
their parent; an unclosed script, style or comment runs to the end of the page, a head to the first element of the body;
of other dropped elements that nothing closes only the tag goes. A line break element is white space within a block.
Repeated rows repeat; null ids stay null; extra columns stay, but for input columns named text or n_chars, which the
result replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 20_000
PRIOR = 20.0
#: What a word loses by the kind of its container before pages are seen, and how far counts may move that.
KIND_LOSS = {"menu": 3.0, "foot": 3.0, "ad": 3.0, "notice": 3.0, "comment": 3.0, "form": 3.0, "rail": 3.0, "head": 3.0, "side": 1.2, "share": 1.2}
MOVE = 0.9
#: The most that a word gains or loses by what it stands in, a boilerplate word in all, and a tag loses, so that an advert
#: within an article doesn't end it.
MOST_TEXT, LEAST_WORD, LEAST_TAG = 2.5, 1.0, 2.0
#: The sum below which a region may not be the content, about one sentence.
ENOUGH = 15.0
#: Words of a block from which it counts as longer.
BLOCK_SIZES = (4, 10, 25)

_DROP = ("script", "style", "noscript", "template", "svg", "head", "iframe", "object", "select", "textarea", "button")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_SPACES = frozenset("br td th img input option wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose nesting is followed.
_HOLDS = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figure footer form header li main menu nav ol section table td th tr ul a".split())
_TAGS = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "fieldset": "form"}
_ROLES = {"navigation": "menu", "menu": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "form": "form"}
_NAMES = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topnav subnav",
    "head": "header masthead topbar siteheader",
    "foot": "footer copyright colophon sitefooter",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail",
    "ad": "ad ads adv advert adverts advertisement advertisements sponsor sponsored sponsors promo promotion promoted adsense adslot adbox",
    "notice": "cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe subscription paywall signup disclaimer",
    "share": "share sharing social socials follow",
    "comment": "comment comments commentlist disqus reply replies respond discussion",
    "form": "form login search searchbox",
}
_KIND = {word: kind for kind, words in _NAMES.items() for word in words.split()}
#: Names that make an element's header part of the text.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT_NAMES = frozenset("article post entry story".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Kinds that an article or main element inside them refutes. A sidebar outside of articles is a rail.
_WEAK = frozenset(("side", "rail", "head", "share"))
#: Kinds that containers keep whatever they hold.
_FIRM = frozenset(("foot", "comment", "hidden"))
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u00bb)]*\s*\Z")
_HEAD = re.compile(r"<(?:!--|(" + "|".join(_DROP) + r")(?=[\s/>])|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])", re.IGNORECASE)
_SPECIAL = re.compile("[>\"']")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _DROP}
#: What else ends a head, as its end tag may be left out.
_CLOSING["head"] = re.compile(r"</head\s*>|(?=<(?!(?:base|basefont|bgsound|link|meta|title|style|script|noscript|template|command)[\s/>])[a-z])", re.IGNORECASE)
_RAW_HEAD = re.compile(r"<(script|style|noscript|template|title)(?=[\s/>])|<!--", re.IGNORECASE)
_EMPTY_COMMENT = re.compile("<!---?>")
_COMMENT_END = re.compile("--!?>")
_TITLE_END = re.compile(r"</title\s*>", re.IGNORECASE)
#: Longer attributes are not worth a place in the cache of kinds.
_CACHED = 2000


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of what is no text; the name of a comment, declaration or dropped element is empty.

    A quoted value has any length and ends at its quote; a quote that none follows stands for itself. A tag that no
    ">" ends is text. Attempts that fail remember the quotes they met outside of values, where a later attempt would
    go the same way, so a page takes time in proportion to its length.
    """
    last, last_end = {q: page.rfind(q) for q in "\"'"}, page.rfind(">")
    failed: set[int] = set()
    special = -1

    def tag_end(at: int) -> int:
        nonlocal special
        if at > last_end:
            return -1
        if special < at:
            special = _SPECIAL.search(page, at).start()
        where, met = special, []
        while where not in failed:
            c = page[where]
            if c == ">":
                return where
            met.append(where)
            after = page.find(c, where + 1) + 1 if where < last[c] else where + 1
            found = _SPECIAL.search(page, after)
            if found is None:
                break
            where = found.start()
        failed.update(met)
        return -1

    unclosed: set[str] = set()

    def closed(name: str, at: int) -> int:
        """Where an element ends, -1 if nothing closes it."""
        if name in unclosed:
            return -1
        closing = _CLOSING[name].search(page, at)
        if not closing:
            unclosed.add(name)
        return closing.end() if closing else -1

    def dropped(name: str, end: int) -> int:
        """Where an element that is not read ends; end: of its start tag."""
        at = end + 1
        if name in ("svg", "iframe", "object", "template") and page[end - 1] == "/":
            return at
        if name == "head":  # raw elements in it may hold anything
            while True:
                closing, raw = _CLOSING["head"].search(page, at), _RAW_HEAD.search(page, at)
                if raw is None or closing and closing.start() < raw.start():
                    return closing.end() if closing else len(page)
                if empty := _EMPTY_COMMENT.match(page, raw.start()):
                    at = empty.end()
                elif raw[1] is None:
                    found = _COMMENT_END.search(page, raw.end())
                    at = found.end() if found else len(page)
                elif raw[1].lower() == "title":
                    found = _TITLE_END.search(page, raw.end())
                    at = found.end() if found else raw.end()
                else:
                    inner = closed(raw[1].lower(), raw.end())
                    at = inner if inner >= 0 else len(page) if raw[1].lower() in ("script", "style") else raw.end()
                if at >= len(page):
                    return len(page)
        inner = closed(name, at)
        return inner if inner >= 0 else len(page) if name in ("script", "style") else at

    at = 0
    while head := _HEAD.search(page, at):
        start, at = head.start(), head.end()
        if head[1] or head[3]:
            end = tag_end(at)
            if end >= 0 and head[1]:
                yield start, (at := dropped(head[1].lower(), end)), False, "", ""
                continue
            if end >= 0:
                yield start, end + 1, bool(head[2]), head[3].lower(), page[at:end]
                at = end + 1
                continue
            if not head[2]:
                at = start + 1
                continue
        if empty := _EMPTY_COMMENT.match(page, start):
            end = empty.end()
        elif page.startswith("<!--", start):
            found = _COMMENT_END.search(page, at)
            end = found.end() if found else len(page)
        else:
            end = page.find(">", start + 2) + 1 if start + 2 <= last_end else 0
        if end:
            yield start, end, False, "", ""
        at = end or start + 1


@lru_cache(maxsize=4096)
def _kind(name: str, attributes: str, inside: bool) -> str:
    """The boilerplate kind that an element suggests, or "". inside: an article or main element is around it."""
    if name in ("main", "a", "li", "tr", "td", "th", "dd", "dt"):
        return ""
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(values.get(k, ""))}
    if "hidden" in attributes.lower().split() or re.search(r"display\s*:\s*none", values.get("style", "")):
        return "hidden"
    if name == "article":  # readers' comments are articles on some pages
        return "comment" if words & {"comment", "comments", "reply"} else ""
    kind = _ROLES.get(values.get("role", "").lower()) or _TAGS.get(name) or ""
    if not kind:
        kinds = {_KIND[w] for w in words if w in _KIND}
        if words & _CONTENT_NAMES:
            kinds -= _WEAK
        kind = min(kinds, key=lambda k: (-KIND_LOSS[k], k), default="")
    if kind == "head" and inside:
        return ""
    return "rail" if kind == "side" and not inside else kind


def parsed(page: str, released: frozenset[int] = frozenset()) -> list[tuple]:
    """Items in page order: ("t", context, text) for text, ("s",) for white space, ("g", name, ends a block, is white space,
    kind, container) for tags, ("x", in or out, name, number) for the start and end of article and main elements and of those
    that suggest a kind. A context is
    (kind, in a link, in a list or a heading, container): containers that suggest a kind are numbered from 1, 0 is none.
    Released containers suggest none, unless their kind is firm."""
    items: list[tuple] = []
    stack: list[tuple[str, str, int]] = []  # name, kind, number
    depths: dict[str, list[int]] = defaultdict(list)  # of each name, where it is on the stack
    #: After each element of the stack, (kind, number) of the innermost hidden container, of the outermost one that no
    #: article refutes, and of the outermost one that none has refuted.
    states: list[tuple] = [(None, None, None)]
    kind, holder, links, lists, inside, at, numbered, heading = "", 0, 0, 0, 0, 0, 0, ""

    def text(a: int, b: int) -> None:
        if a < b and not page[a:b].isspace():
            items.append(("t", (kind, links > 0, "heading" if heading else "list" if lists else "", holder), page[a:b]))
        elif a < b:
            items.append(("s",))

    def around() -> None:
        """The kind that holds: hidden, else that of the outermost container, weak ones only from the innermost article on."""
        nonlocal kind, holder
        hidden, _, outer = states[-1]
        kind, holder = hidden or outer or ("", 0)

    def close(depth: int) -> None:
        nonlocal links, lists, inside
        while len(stack) > depth:
            gone, own, number = stack.pop()
            depths[gone].pop()
            states.pop()
            links -= gone == "a"
            lists -= gone == "li"
            inside -= gone in ("article", "main")
            if own or gone in ("article", "main"):
                items.append(("x", -1, gone, number))
        around()

    for start, end, closes, name, attributes in tokens(page):
        text(at, start)
        at = end
        if not name:
            continue
        if name in _BLOCKS:
            heading = name if not closes and name in _HEADINGS else "" if name not in _HEADINGS or name == heading else heading
        if closes:
            if depths.get(name):
                close(depths[name][-1])
        elif name in _HOLDS and name not in _VOID and not attributes.endswith("/"):
            if name in ("a", "li") and depths.get(name) and depths[name][-1] == max(depths[k][-1] for k in (name, "ul", "ol", "menu", "div") if depths.get(k)):
                close(depths[name][-1])
            own = (_kind if len(attributes) <= _CACHED else _kind.__wrapped__)(name, attributes, inside > 0)
            marked = name in ("article", "main")
            numbered += marked or own != ""
            if numbered in released and own and own not in _FIRM:
                own = ""
            hidden, firm, outer = states[-1]
            if marked:
                outer = firm
            if own == "hidden":
                hidden = own, numbered
            elif own:
                firm, outer = firm or (None if own in _WEAK else (own, numbered)), outer or (own, numbered)
            depths[name].append(len(stack))
            stack.append((name, own, numbered))
            states.append((hidden, firm, outer))
            if own or marked:
                items.append(("x", 1, name, numbered))
            inside += marked
            around()
            links += name == "a"
            lists += name == "li"
        items.append(("g", name, name in _BLOCKS, name in _SPACES, kind, holder))
    text(at, len(page))
    close(0)
    return items


def blocks_of(items: list[tuple]) -> dict[int, tuple[int, bool]]:
    """Of each text item's place: the size class of its block, and whether the block ends like a sentence."""
    out: dict[int, tuple[int, bool]] = {}
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            own = (sum(size >= n for n in BLOCK_SIZES), _SENTENCE.search(items[held[-1]][2][-8:]) is not None)
            out.update(dict.fromkeys(held, own))
            held.clear()
        size = 0

    for k, item in enumerate(items):
        if item[0] == "t":
            held.append(k)
            size += item[2].count(" ") + 1
        elif item[0] == "g" and item[2]:
            flush()
    flush()
    return out


class Weights:
    def __init__(self, counts: dict[str, tuple[int, int]]):
        """counts: key -> (inside, outside) of labelled pages."""
        self.counts, self.cache = counts, {}

    def _odds(self, key: str, prior: float) -> float:
        inside, outside = self.counts.get(key, (0, 0))
        return math.log((inside + PRIOR * prior) / (outside + PRIOR * (1 - prior)))

    def word(self, kind: str, link: bool, place: str, size: int, sentence: bool) -> float:
        """Never above a loss of LEAST_WORD below zero."""
        key = kind, link, place, size, sentence
        if key not in self.cache:
            if kind == "hidden":
                score = -LEAST_WORD
            else:
                prior = (0.25 if place == "list" else 0.45) if link else (0.7 if place else 0.6, 0.7, 0.8, 0.85)[size] + 0.08 * sentence
                score = max(-MOST_TEXT, min(MOST_TEXT, self._odds(_text_key(link, place, size, sentence), prior)))
                if kind:
                    loss = KIND_LOSS[kind]
                    score += max(-loss - MOVE, min(MOVE - loss, self._odds(_kind_key(kind), 1 / (1 + math.exp(loss)))))
            self.cache[key] = max(-LEAST_WORD, score) if kind else score
        return self.cache[key]

    def tag(self, name: str, kind: str) -> float:
        key = _tag_key(name, kind)
        if key not in self.cache:
            self.cache[key] = min(-0.05, max(-LEAST_TAG, self._odds(key, 0.4)))
        return self.cache[key]


def _text_key(link: bool, place: str, size: int, sentence: bool) -> str:
    return f"text {size}{' link' * link} {place}{' sentence' * sentence}"


def _kind_key(kind: str) -> str:
    return f"kind {kind}"


def _tag_key(name: str, kind: str) -> str:
    return f"tag {name if name in _BLOCKS or name in _HOLDS or name in _SPACES else 'other'} {kind or 'plain'}"


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest positive sum, the first and shortest of those; else (0, 0)."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return found


def whole(items: list[tuple], first: int, last: int) -> tuple[int, int]:
    """The run, or all of the innermost article, main or kind-suggesting element that holds it, as its first and last
    blocks may be short."""
    opened: dict[int, int] = {}
    for k, item in enumerate(items):
        if item[0] == "x" and item[1] == 1 and k < last:
            opened[item[3]] = k
        elif item[0] == "x" and item[3] in opened:
            start = opened.pop(item[3])
            if start <= first < last <= k + 1:  # inner elements end first
                return start, k
    return first, last


def scored(items: list[tuple], weights: Weights, names: bool = True) -> list[float]:
    """Scores of the items; names: with what the kinds of containers cost, else only that of firm ones."""
    block, scores = blocks_of(items), [0.0] * len(items)
    for k, item in enumerate(items):
        if item[0] == "t":
            kind, link, place, _ = item[1]
            scores[k] = weights.word(kind if names or kind in _FIRM else "", link, place, *block[k]) * (item[2].count(" ") + 1)
        elif item[0] == "g":
            scores[k] = weights.tag(item[1], item[4] if names or item[4] in _FIRM else "")
    return scores


def misnamed(items: list[tuple], weights: Weights) -> frozenset[int]:
    """The containers that hold more than half of what the scan finds without regard to names, if that is enough."""
    scores = scored(items, weights, names=False)
    first, last = region(scores)
    if sum(scores[first:last]) < ENOUGH:
        return frozenset()
    gained, total, opened, out = [0.0], 0.0, {}, set()
    for k, score in enumerate(scores):
        total += max(0.0, score) if first <= k < last else 0.0
        gained.append(total)
    for k, item in enumerate(items):
        if item[0] == "x" and item[1] == 1:
            opened[item[3]] = k
        elif item[0] == "x" and gained[k] - gained[opened.pop(item[3])] > total / 2:
            out.add(item[3])
    return frozenset(out)


def left_out(items: list[tuple], scores: list[float], run: tuple[int, int], whole_run: tuple[int, int]) -> set[int]:
    """Places of texts that don't belong to the region: in containers whose sum is zero or less, if the scan's run goes on
    at both sides of them or hasn't reached them."""
    own: Counter = Counter()
    for k in range(*whole_run):
        item = items[k]
        if item[0] == "t" and item[1][3]:
            own[item[1][3]] += scores[k]
        elif item[0] == "g" and item[5]:
            own[item[5]] += scores[k]
    poor = {k for k in range(*whole_run) if items[k][0] == "t" and items[k][1][3] and own[items[k][1][3]] <= 0}
    rich = [k for k in range(*run) if items[k][0] == "t" and k not in poor]
    return {k for k in poor if not run[0] <= k < run[1] or rich and rich[0] < k < rich[-1]}


def extract(page: str | None, weights: Weights) -> str:
    """Blocks of the main text, joined by newlines."""
    items = parsed(page or "")
    scores = scored(items, weights)
    run = region(scores)
    marked = sum(item[1] for item in items[: run[0]] if item[0] == "x" and item[2] in ("article", "main")) > 0
    if not marked and sum(scores[slice(*run)]) < ENOUGH and (free := misnamed(items, weights)):
        items = parsed(page, free)
        scores = scored(items, weights)
        run = region(scores)
    whole_run = whole(items, *run)
    out = left_out(items, scores, run, whole_run)
    blocks, held = [], []
    for k in range(*whole_run):
        item = items[k]
        if item[0] == "t":
            if item[1][0] != "hidden" and k not in out:
                held.append(item[2])
        elif item[0] == "s" or item[0] == "g" and item[3]:
            held.append(" ")
        elif item[0] == "g" and item[2]:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def counted(page: str) -> Counter:
    """(key, inside) -> words or tags, of a page with one article; else empty."""
    items = parsed(page)
    opens = [k for k, i in enumerate(items) if i[0] == "x" and i[1] == 1 and i[2] == "article"]
    out: Counter = Counter()
    if len(opens) != 1:
        return out
    end = next(k for k, i in enumerate(items) if i[0] == "x" and i[1] == -1 and i[2] == "article")
    block = blocks_of(items)
    for k, item in enumerate(items):
        inside = opens[0] + 1 < k < end  # the element's own tag lies outside
        if item[0] == "t":
            kind, link, place, _ = item[1]
            words = len(item[2].split())
            if link or inside or not kind:  # sentences outside that their container explains are no evidence against sentences
                out[_text_key(link, place, *block[k]), inside] += words
            if kind:
                out[_kind_key(kind), inside] += words
        elif item[0] == "g":
            out[_tag_key(item[1], item[4]), inside] += 1
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            total.update(counted(page.as_py() or ""))
    keys = sorted({k for k, _ in total})
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k, True] for k in keys], pa.int64()), pa.array([total[k, False] for k in keys], pa.int64())], names=["key", "inside", "outside"])


def train(spark: SparkSession, pages: DataFrame, about: int = TRAIN_PAGES) -> Weights:
    share = min(1.0, about / max(1, pages.count()))
    sample = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    sums = sample.select("html").mapInArrow(_count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights({r["key"]: (r["inside"], r["outside"]) for r in sums.collect()})  # tag names and contexts: a fixed number


def main_text(spark: SparkSession, pages: DataFrame, weights: Weights) -> DataFrame:
    """pages (with html) and text, n_chars instead of html."""
    rest = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    shared = spark.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [extract(t.as_py(), shared.value) for t in part.column("html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in rest]
    return pages.select(*rest, "html").mapInArrow(apply, ", ".join([*fields, "text string", "n_chars long"]))
