"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from runquarry.llm.common import slices

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")

# Elements of the language by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div aside nav body td th tbody".split())
# Words that name parts of a page beside its article.
_ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu svg object canvas audio video fieldset".split())
_ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
                         "notices notification alert comment comments disqus reply replies sidebar menu nav navbar navigation breadcrumb "
                         "breadcrumbs footer header masthead related share sharing social subscribe subscription newsletter signup login popup "
                         "modal overlay widget pagination pager search contentinfo complementary".split())
# Of these, those that may also describe a page or layout with such a part in it ("has-sidebar", "nav-open", a page in a form).
_LAYOUT_TAGS = frozenset(("form", "fieldset"))
_LASTING_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies "
                           "breadcrumb breadcrumbs related".split())
_STATE_WORDS = frozenset("has no with without is not show hide open opened closed enabled disabled on off".split())
_HEADER_WORDS = frozenset(("header", "masthead"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))
# Elements that are a part of the text around them; any other holds a text of its own.
_PARTS = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th blockquote pre figure figcaption "
                             "address details summary hr".split())


def aside_mark(tag: str, attributes: str, main: bool) -> int:
    """What an element's tag, class, id and role say: 2 for a part beside the article, 1 if the same words may also
    describe a layout around it, 0 otherwise. ``main``: within ``article`` or ``main``, where headers and headings belong to
    the text."""
    if tag in _ASIDE_TAGS or tag == "header" and not main:
        return 1 if tag in _LAYOUT_TAGS else 2
    if "=" not in attributes or main and tag in _HEADINGS:
        return 0
    mark = 0
    for name in " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).split():
        words = {x.lower() for x in _NAME.findall(name)}
        found = words & _ASIDE_WORDS
        if main:
            found -= _HEADER_WORDS
        if found:
            mark = max(mark, 2 if found & _LASTING_WORDS and not words & _STATE_WORDS else 1)
    return mark


def path_blocks(html: str):
    """(blocks, parents, above, holder, kinds): blocks are (text, path, main, element); ``parents[path]`` is the path one tag
    up, ``above[element]`` the element around one. ``holder[element]`` is the outermost ``article`` or ``main`` around it,
    without these the nearest element that holds a text of its own; both count the element itself. ``kinds[element]``
    is its ``aside_mark``, -1 for an outermost ``article`` or ``main``, -2 for an ``h1`` within.

    One pass with a stack. Unclosed tags are closed where the language says so: a block ends an open paragraph, list
    items and cells end their predecessors. Block elements end a block of text, inline ones do not.
    """
    paths: dict[tuple[int, str], int] = {}
    parents = [-1]
    above, holder, kinds = [-1], [0], [0]
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, path, main, element
    blocks, text = [], []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            at = next(x for x in reversed(stack) if x[0] not in _INLINE)
            blocks.append((joined, *at[1:]))

    def drop_to(depth: int) -> None:
        if any(x[0] not in _INLINE for x in stack[depth:]):
            flush()
        del stack[depth:]

    def innermost(tags, stop=_SCOPE) -> int | None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return None
        return None

    at, lowered = 0, None
    while True:
        m = _TOKEN.search(html, at)
        if not m:
            text.append(unescape(html[at:]))
            break
        if m.start() > at:
            text.append(unescape(html[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            i = innermost((tag,), stop=())
            if i is not None:
                drop_to(i)
            continue
        if tag in _RAW:
            lowered = html.lower() if lowered is None else lowered
            lowered = lowered if len(lowered) == len(html) else "".join(c.lower() if c.isascii() else c for c in html)
            if not m[3].endswith("/"):
                end = lowered.find("</" + tag, at)
                close = html.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(html)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _INLINE:
            i = innermost(("p",), stop=("td", "th", "button", "table"))
            if i is not None:
                drop_to(i)
            if tag in _CLOSES:
                i = innermost(_CLOSES[tag], stop=_SCOPE - _CLOSES[tag])
                if i is not None:
                    drop_to(i)
            flush()
        if tag in _VOID or m[3].endswith("/") and tag in _INLINE:
            continue
        _, path, main, around = stack[-1]
        element = len(above)
        above.append(around)
        holder.append(holder[around] if main or tag in _PARTS else element)
        if tag not in _INLINE:
            key = path, tag
            if key not in paths:
                paths[key] = len(parents)
                parents.append(path)
            path = paths[key]
        if tag in _MAIN:
            kind, main = 0 if main else -1, True
        elif tag in ("html", "body"):
            kind = 0
        else:
            kind = aside_mark(tag, m[3], main)
            if kind and tag in _INLINE and tag != "label":
                flush()
            kind = -2 if main and tag == "h1" else kind
        kinds.append(kind)
        stack.append((tag, path, main, element))
    flush()
    return blocks, parents, above, holder, kinds


def beside(blocks, above: list[int], kinds: list[int], most: float = 0.75) -> list[bool]:
    """Whether each element is beside the article, by its own mark or one above it.

    A layout's mark does not count for an element with ``most`` of the text outside parts that are surely beside, nor
    for an outermost ``article`` or ``main`` or its ``h1`` below it. Where nothing else would be left, no mark above an
    ``article`` or ``main`` counts.
    """
    size = [0] * len(above)
    for b in blocks:
        size[b[3]] += len(b[0])
    sure = [k == 2 for k in kinds]
    for e in range(1, len(above)):  # elements come before those in them
        sure[e] = sure[e] or sure[above[e]]
    size = [0 if x else n for n, x in zip(size, sure)]
    for e in range(len(above) - 1, 0, -1):
        size[above[e]] += size[e]
    for cleared in (1, 2):  # the strongest mark that does not reach into an article
        state = [0] * len(above)
        for e in range(1, len(above)):
            up, kind = state[above[e]], kinds[e]
            if kind == -1 and up <= cleared or kind == -2 and up <= 1:
                state[e] = 0
            else:
                state[e] = max(up, 0 if kind < 0 or kind == 1 and size[e] >= most * size[0] else kind)
        if any(not state[b[3]] for b in blocks):
            break
    return [x > 0 for x in state]


def main_text(html: str, threshold: float = 0.05, outside: float = 0.02) -> str:
    """The article of a page: its content blocks joined by line breaks.

    For every root-to-leaf tag path the text length and the punctuation marks of its blocks are summed and divided by
    the number of blocks. Both ratios are smoothed over the tree of paths (a path counts 1/2 per step of distance,
    which two sweeps over the tree give exactly), so a heading or list is judged with the paragraphs around it.
    Their fusion is length times (1 + punctuation). Paths outside ``article`` and ``main`` count ``outside`` where a
    page has text within these; blocks in elements beside the article by tag, class, id or role (menus, headers,
    footers, adverts, notices, forms, comments; see ``beside``) are left out beforehand.

    The scores choose between subtrees: of an outermost ``article`` or ``main`` with a path of at least ``threshold`` times
    the best all blocks are content, however short and nested; so are, elsewhere, all blocks of an element that holds
    a block whose path comes to that by its own ratios. Other blocks are content if their path is.
    """
    blocks, parents, above, holder, kinds = path_blocks(html)
    aside = beside(blocks, above, kinds)
    blocks = [b for b in blocks if not aside[b[3]]]
    if not blocks:
        return ""
    length, marks, count = ([0.0] * len(parents) for _ in range(3))
    inside: dict[int, bool] = {}
    for text, path, main, _ in blocks:
        length[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
        inside[path] = main

    def smooth(x: list[float]) -> list[float]:
        up = list(x)
        for v in range(len(up) - 1, 0, -1):  # parents come before their children
            up[parents[v]] += up[v] / 2
        for v in range(1, len(up)):
            up[v] = up[v] + (up[parents[v]] - up[v] / 2) / 2
        return up

    some = smooth([float(n > 0) for n in count])
    ratio = [a / b if b else 0.0 for a, b in zip(smooth([x / n if n else 0.0 for x, n in zip(length, count)]), some)]
    signs = [a / b if b else 0.0 for a, b in zip(smooth([x / n if n else 0.0 for x, n in zip(marks, count)]), some)]
    has_main = any(inside.values())
    score = {p: ratio[p] * (1 + signs[p]) * (1 if inside[p] or not has_main else outside) for p in inside}
    least = threshold * max(score.values())  # far from any text a path's ratio may vanish; paths with text have their own
    own = {p: length[p] / count[p] * (1 + marks[p] / count[p]) * (1 if inside[p] or not has_main else outside) for p in inside}
    whole = [False] * len(above)
    for _, path, main, element in blocks:
        if (score if main else own)[path] >= least:
            whole[holder[element]] = True
    for e in range(1, len(above)):  # elements come before those in them
        whole[e] = whole[e] or whole[above[e]]
    return "\n".join(b[0] for b in blocks if whole[b[3]] or score[b[1]] >= least)


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), block_bytes: int = 4_000_000) -> DataFrame:
    """``key``, the ``keep`` columns, ``text`` and ``n_chars`` (its code points) for every page, from the whole html.

    Pages are independent: nothing is shuffled, and Python holds a few megabytes of pages at a time. Null or empty
    html, or a page without content: empty text, 0 characters. Null and repeated keys are kept as they are.
    """
    columns = [key, *[c for c in keep if c not in (key, "text", "n_chars")]]

    def run(batches):
        for batch in batches:
            for some in slices(batch, "_html", block_bytes):
                texts = [main_text(h) if h else "" for h in some.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in columns], pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    rows = pages.select(*columns, pages[html].alias("_html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns) + ", text string, n_chars bigint"
    return rows.mapInArrow(run, schema)
