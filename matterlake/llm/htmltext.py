"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Pass one looks at each block by
itself: where it stands (menus, page headers and footers, sidebars, notices,
adverts, forms and reader comments are out; an ``article`` or ``main`` element
says where the text is), its link density, its length and its density of stop
words.  Blocks that this leaves open (short, or of few stop words) inherit in
pass two from the nearest decided blocks before and after them in the same part
of the page.

Markup is read leniently: unclosed, crossing and cut-off tags are usual.  What
a page may have in its ``head`` is no text anywhere, so the head needs no end.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import map_batches, small_batches

# Element names (fixed values).
RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|textarea|select|title"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form "
    "header main menu nav ol section table tbody td tr ul button label".split()
)
OUT_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Their attributes tell of the page, those of main and article often its layout.
PAGE_TAGS = frozenset("html head body".split())
TEXT_TAGS = frozenset("main article".split())
# Words of class, id and role that name a part beside the text (fixed values).
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent notice notices gdpr popup modal overlay newsletter "
    "subscribe signup login share sharing social sidebar side widget widgets comment "
    "comments respond replies reply disqus nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager footer masthead related recommended recommendations "
    "toolbar search tags meta disclaimer copyright hidden contentinfo complementary "
    "alert alertdialog form skip".split()
)

# Frequent words of English, French, German and Spanish (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in into is "
    "it its more not of on or our she that the their them there they this to was we were "
    "what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous "
    "on ou par pas pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dem den der die ein eine einem einen einer er es für "
    "hat ich im ist mit nach nicht noch oder sich sie sind so um und von war wie wir zu zum "
    "al como con del el ella era esta este está fue hay la las lo los más muy no nos o para "
    "pero por se ser si sin su sus una y ya".split()
)

SHORT, LONG = 70, 100
LOW, HIGH = 0.15, 0.30
MOST_LINKS = 0.5

GOOD, BAD, OPEN = 1, 0, -1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _names_other_part(attributes: str, named: tuple[str, ...] = ("class", "id", "role")) -> bool:
    if not attributes:
        return False
    if "=" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in named:
                if OUT_WORDS.intersection(_PART.findall(value)):
                    return True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            elif name == "aria-hidden" and value == "true":
                return True
    return re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes.lower()) is not None


class _Block:
    __slots__ = ("parts", "linked", "out", "inside", "scope", "text", "label")

    def __init__(self, out: bool, inside: bool, scope: int):
        self.parts: list[str] = []
        self.linked = 0
        self.out, self.inside, self.scope = out, inside, scope


def blocks(page: str) -> tuple[list[_Block], bool]:
    """The blocks with text, in order; whether the page marks its main part."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, bool, int]] = []
    marked, scopes, links = False, 0, 0
    out, inside, scope = False, False, 0
    block = _Block(False, False, 0)

    def begin(own_out: bool = False) -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = _Block(out or own_out, inside, scope)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2) == "/"
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in CONTAINERS or tag not in BLOCK_TAGS:
            attributes = m.group(4)
            if closing or tag in PAGE_TAGS:
                other = False
            elif (tag in TEXT_TAGS or 'role="main"' in attributes) and not any(s[0] == "article" for s in stack):
                other = _names_other_part(attributes, ("role",))
            else:
                # An article inside an article is usually a comment.
                other = _names_other_part(attributes)
            if tag in CONTAINERS or other:
                if closing:
                    if any(s[0] == tag for s in stack):
                        while stack.pop()[0] != tag:
                            pass
                        _, out, inside, scope = stack[-1] if stack else ("", False, False, 0)
                        links = 0
                elif not attributes.endswith("/"):
                    out = out or other or tag in OUT_TAGS or (tag == "header" and not inside)
                    if tag in ("article", "main") or 'role="main"' in attributes:
                        inside = True
                        if not out:
                            marked = True
                            if not any(s[2] for s in stack):
                                scopes += 1
                                scope = scopes
                    stack.append((tag, out, inside, scope))
                begin()
            elif closing and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                _, out, inside, scope = stack[-1] if stack else ("", False, False, 0)
                begin()
            continue
        links = 0 if closing or tag in ("p", "li") else links
        begin(not closing and _names_other_part(m.group(4)))
    if at < len(page):
        block.parts.append(page[at:])
    begin()
    kept = []
    for b in found:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept, marked


def classify(kept: list[_Block], marked: bool) -> None:
    """Pass one: each block by itself."""
    for b in kept:
        n = len(b.text)
        if b.out or (marked and not b.inside):
            b.label = BAD
            continue
        if b.linked > MOST_LINKS * n:
            b.label = BAD
            continue
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if n < SHORT:
            b.label = OPEN
        elif stops >= HIGH and n > LONG:
            b.label = GOOD
        elif b.inside:
            b.label = GOOD if stops >= LOW else OPEN
        else:
            b.label = OPEN if stops >= LOW else BAD


def inherit(kept: list[_Block], marked: bool) -> None:
    """Pass two: open blocks take after their nearest decided neighbours.

    Only neighbours in the same marked part count.  Where they disagree the
    nearer one wins, a tie and a part without decided blocks go by whether the
    page marks the part as its text.  A page that marks nothing and has no block
    that stands by itself keeps its open blocks.
    """
    n = len(kept)
    if not marked and not any(b.label == GOOD for b in kept):
        # Nothing to take after: what no rule speaks against is the text.
        for b in kept:
            b.label = GOOD if b.label == OPEN else b.label
        return
    before, after = [(n, OPEN)] * n, [(n, OPEN)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        label, far, scope = OPEN, n, None
        for i in order:
            b = kept[i]
            if b.scope != scope:
                label, far, scope = OPEN, n, b.scope
            if b.label != OPEN:
                label, far = b.label, 0
            else:
                far += 1
                side[i] = (far, label)
    for i, b in enumerate(kept):
        if b.label == OPEN:
            sides = [s for s in (before[i], after[i]) if s[1] != OPEN]
            said = {s[1] for s in sides}
            if not said:
                b.label = GOOD if b.inside else BAD
            elif len(said) == 1:
                b.label = said.pop()
            elif sides[0][0] != sides[1][0]:
                b.label = min(sides)[1]
            else:
                b.label = GOOD if b.inside else BAD


def main_text(page: str | None) -> str:
    """The kept blocks, one a line; null, empty and text-less pages: ``''``."""
    if not page:
        return ""
    kept, marked = blocks(page)
    classify(kept, marked)
    inherit(kept, marked)
    return "\n".join(b.text for b in kept if b.label == GOOD)


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``source``, and the main text as ``name``.

    A column ``name`` of ``pages`` is replaced; repeated rows are rows.
    """
    small_batches(pages.sparkSession, 500)
    kept = [c for c in pages.columns if c not in (source, name)]
    read = pages.select(*kept, F.col(source).cast("string").alias("_page_source"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string())],
            names=[*batch.schema.names[:-1], name],
        )

    return map_batches(read, run, pages.select(*kept).schema.add(name, "string"))
