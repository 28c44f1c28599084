"""Main text of web pages by block rules in two passes.

A page is read once as tags and text. Block elements cut it into blocks; each
knows how many of its characters are in links, how many of its words are stop
words, and the region it stands in. First pass: blocks of navigation, adverts,
forms and the like, and blocks that are mostly links, are boilerplate; long
blocks with enough stop words are content; the rest is open. Second pass: an
open block takes the label of the nearest decided neighbour; inside an article
only neighbours of that article count, and one without any is content. With
neighbours on both sides equally near, paragraphs and headings are content.

Nulls and the like: null and empty pages have an empty text; pages cut off in
the middle of a tag lose that tag only; unclosed elements end with the one they
stand in; ids and addresses are carried as they are, null or repeated ones too;
an empty table gives no rows. Other columns are not read. White space is what
``str.split`` takes for it, hard spaces included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import pieces
from lodestar.session import small_batches

#: Bytes of pages that a task handles at once.
CHUNK = 4 << 20
#: A block with more than this share of its characters in links is boilerplate.
LINKS = 0.5
#: Characters of a block that is long enough to be judged by itself; shares of stop words that decide it.
LONG, STOP_HIGH, STOP_LOW = 70, 0.3, 0.1

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem
    le la les et un une du est que qui dans pour par au ne pas sur se plus ce avec sont il aux son ses ou mais comme nous
    el los las y en del se por con una su para lo al más sus fue este entre cuando todo esta ser son dos también""".split()
)
# Elements that are not read at all, that end a block, and that have no end tag.
UNREAD = frozenset("script style noscript template textarea title iframe noframes noembed object svg math canvas audio video select datalist button".split())
RAW = frozenset("script style textarea title iframe noframes noembed".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and roles of boilerplate and of content, and words of class and id that tell boilerplate.
OUTSIDE = frozenset("nav footer aside form menu dialog search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager toolbar widget copyright masthead topbar""".split()
)
REMARKS = frozenset("comment comments commentlist disqus replies respond reviews".split())
ABSENT = frozenset("has with no without count counter".split())
NEUTRAL = ABSENT | frozenset("content main article post entry story page body wrapper container layout".split())

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?|="""
_MARKUP = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_VALUE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

PLAIN, ARTICLE, OUT, REMARK = "", "article", "out", "remark"


@dataclass
class Block:
    """``region`` is PLAIN, OUT, or the number of an article; ``words`` and ``stops`` count words."""

    text: str
    tag: str
    region: str | int
    linked: int
    words: int
    stops: int

    @property
    def link_density(self) -> float:
        return self.linked / max(len(self.text), 1)

    @property
    def stop_density(self) -> float:
        return self.stops / max(self.words, 1)


def _region(name: str, attributes: str) -> str:
    """What an element says of the text in it; PLAIN if nothing."""
    got: dict[str, str] = {}
    for m in _VALUE.finditer(attributes):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    hints = {w.lower() for k in ("class", "id") for w in _HINT.findall(unescape(got.get(k, "")))}
    role = got.get("role", "").lower()
    if hints & REMARKS and name not in ("main", "body", "html") and not hints & (NEUTRAL if name == "article" else ABSENT):
        return REMARK
    if name in ("article", "main") or role in ("main", "article") or got.get("itemprop") == "articleBody":
        return ARTICLE
    if name in ("body", "html"):
        return PLAIN
    if "hidden" in got or _NO_DISPLAY.search(got.get("style", "")):
        return OUT
    if name in OUTSIDE or role in OUTSIDE_ROLES or (hints & HINTS and not hints & NEUTRAL):
        return OUT
    return "header" if name == "header" else PLAIN


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, with what the rules need to know of each."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, str | int]] = []  # open block elements and the region inside each
    state = {"linked": 0, "link": 0, "articles": 0, "tag": ""}

    def here() -> str | int:
        return stack[-1][1] if stack else PLAIN

    def text(raw: str) -> None:
        if raw:
            t = unescape(raw) if "&" in raw else raw
            parts.append(t)
            if state["link"]:
                state["linked"] += len(" ".join(t.split()))

    def end(tag: str) -> None:
        t = " ".join("".join(parts).split())
        if t:
            region = here()
            if region in (OUT, REMARK):
                out.append(Block(t, state["tag"], OUT, 0, 0, 0))
            else:
                words = _WORD.findall(t.lower())
                out.append(Block(t, state["tag"], region, state["linked"], len(words), sum(w in STOP_WORDS for w in words)))
        parts.clear()
        state["linked"], state["tag"] = 0, tag

    at = 0
    while m := _MARKUP.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue  # a comment or declaration
        name = m[2].lower()
        if m[1]:  # an end tag
            if name == "a":
                state["link"] = 0
            elif name in BLOCKS:
                end("")
                if name != "p":
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
            continue
        if name in UNREAD and not m[3].endswith("/"):
            parts.append(" ")
            at = _after(html, at, name)
        elif name == "a":
            state["link"] = 1
        elif name == "br":
            text(" ")
        elif name in BLOCKS:
            end(name)
            if name not in VOID and name != "p":
                inside, told = here(), _region(name, m[3])
                if inside == REMARK or told == REMARK:
                    inside = REMARK
                elif told == ARTICLE:
                    # one article in another is part of it
                    if not isinstance(inside, int):
                        state["articles"] += 1
                        inside = state["articles"]
                elif told == OUT or (told == "header" and not isinstance(inside, int)):
                    inside = OUT
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                    inside = stack.pop()[1] if told == PLAIN else inside  # its end tag may be left out
                stack.append((name, inside))
    text(html[at:])
    end("")
    return out


def _after(html: str, at: int, name: str) -> int:
    """Where an element that is not read ends: behind its end tag, or at the end of the page."""
    if name in RAW:
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
        return m.end() if m else len(html)
    depth, tags = 1, re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
    for m in tags.finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return at  # never closed: its tag alone goes


def first_pass(b: Block) -> bool | None:
    """Content, boilerplate, or open (None)."""
    if b.region == OUT:
        return False
    if b.link_density > LINKS:
        return False
    if len(b.text) >= LONG and b.stop_density >= STOP_HIGH:
        return True
    if isinstance(b.region, int):
        return None  # what an article holds is not judged by its words alone
    if "©" in b.text[:40]:
        return False
    if len(b.text) >= LONG and b.stop_density < STOP_LOW:
        return False
    return None


def content(found: list[Block]) -> list[bool]:
    """Whether each block is content."""
    first = [first_pass(b) for b in found]
    before, after = _nearest(found, first, 1), _nearest(found, first, -1)
    out = []
    for b, label, prior, following in zip(found, first, before, after, strict=True):
        if label is not None:
            out.append(label)
            continue
        near = [x for x in (prior, following) if x is not None]
        if not near:
            out.append(isinstance(b.region, int))
        elif len(near) == 2 and prior[0] == following[0] and prior[1] != following[1]:
            out.append(b.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"))
        else:
            out.append(min(near)[1])
    return out


def _nearest(found: list[Block], first: list[bool | None], step: int) -> list[tuple[int, bool] | None]:
    """For each block the (distance, label) of the nearest decided one on one side, within its own article if it has one."""
    out: list[tuple[int, bool] | None] = [None] * len(found)
    last: dict = {}
    order = range(len(found)) if step > 0 else range(len(found) - 1, -1, -1)
    for i in order:
        b = found[i]
        seen = last.get(b.region if isinstance(b.region, int) else "page")
        if seen is not None:
            out[i] = (abs(i - seen[0]), seen[1])
        if first[i] is not None:
            last["page"] = (i, first[i])
            # links and adverts in an article say nothing of the text around them
            if isinstance(b.region, int) and first[i]:
                last[b.region] = (i, True)
    return out


def main_text(html: str | None) -> str:
    """The content blocks of a page, one a line."""
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, kept in zip(found, content(found), strict=True) if kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", CHUNK):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        ids = [batch.column(k) for k in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page ``page_id, url, text, n_chars``: one pass over the pages, no shuffle."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = [p.schema[k].dataType.simpleString() for k in ("page_id", "url")]
    return p.mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


report = extract

#: SQL for pages of the given tables' shape, whose main text is one ``article`` of ``h1`` and ``p`` blocks.
ORACLE_SQL = r"""
with inner_html as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g') as t from pages),
raw as (select page_id, url, list_transform(regexp_split_to_array(t, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '</?b>', '', 'g')) as parts from inner_html),
decoded as (
  select page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&#(39|x27);', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) as parts from raw),
plain as (
  select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from decoded)
select page_id, url, text, length(text)::bigint as n_chars from plain
"""
