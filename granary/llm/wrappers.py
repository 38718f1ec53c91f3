"""Main text of web pages by union-free wrappers of their hosts.

A page is a stream of tokens, one for each text block: the open elements above it, and its text where that stands on
most pages of the host (a fixed token), or else a slot. Runs that repeat next to each other are folded into repeated
groups, and the streams of one host are aligned one after the other: what only some of them have becomes an optional
group, what some repeat becomes a repeated group, texts that differ become a slot. The result, a regular expression
without unions, is the host's wrapper. Its fixed tokens that have one place in it, be it in an optional group, are the
host's template. Each page is matched against the wrapper by them; blocks that they meet are the template's,
such as a call to subscribe in the middle of the article, and all others are the page's own.

Of the page's own blocks those inside elements that hold menus, headers, footers, sidebars, notices, adverts, forms or
reader comments are left out, which no alignment can tell from an article where they vary by page; of the others, those
of the page's main element are the main text, or without one those below the deepest element that holds most of the
text that varies by page. Headings are never template, as a heading goes with what it stands above.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame, functions as F

from . import common

# Fixed values of HTML: elements that don't cut text into blocks, that hold no text of the page, or that have no end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph, and elements that end an open one of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Elements, and words of class, id or role attributes, that hold something other than the article.
OTHER_TAGS = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar complementary contentinfo aside widget share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that a class, id or role of just 'main' makes the main one.
CONTAINERS = frozenset("div section table td".split())
#: A wrapper's text must be this far below one element for that element to be the main one.
MOST = 0.6
LONGEST_GROUP = 8
#: Pages that a host has at least for its fixed texts to count as template.
TEMPLATE_PAGES = 4
#: Share of a host's pages that a text stands on at least to be fixed: some pages, such as empty ones, are of no template.
TEMPLATE_SHARE = 0.75
#: Streams of a host that one task aligns; those of a host with more are aligned in parts, and then what they give.
FAN = 64
#: Numbers of an alignment's table that are held as a whole; of a larger one rows are made twice, which changes no result.
CELLS = 1_000_000
_HEADING = re.compile(r"(?:^|/)h[1-6](?:!\w+)?$")

#: Elements whose content is no markup, or no text of the page, up to their end tag.
RAW = frozenset("script style noscript template svg math iframe object audio video canvas textarea title".split())
#: Those of them that stand inside a line of text.
INSIDE = frozenset("svg math iframe object canvas".split())
#: Open elements that a path names, at most; deeper ones have the path of the last, with the marks of kinds alone. HTML readers limit nesting alike.
DEEPEST = 128
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ODD = re.compile(r"[^a-z0-9:_.-]")
_STOP = re.compile(r">|=\s*([\"'])")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


def _kind(tag: str, attributes: str) -> str:
    """'x' for elements of something else, 'c' for reader comments, 'm' for the main element, '' for others."""
    words: set[str] = set()
    names: set[str] = set()
    if attributes and "=" in attributes:
        for _, a, b, c in _MARK.findall(attributes):
            value = (a or b or c).lower()
            words.update(re.split(r"[^a-z]+", value))
            names.update(value.split())
    if words & COMMENT_WORDS:
        return "c"
    if tag in OTHER_TAGS or words & OTHER_WORDS:
        return "x"
    return "m" if tag in MAIN_TAGS or "main" in names and tag in CONTAINERS else ""


class _Scanner:
    """Markup of a page, each piece of it looked at once, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # places outside of quotes from which no tag's end is to be found
        self.raw_ends: dict[str, int] = {}

    def tag_end(self, at: int) -> int:
        """The place after the > of a tag, from behind its name; values in quotes may hold >. A quote that is never closed is none. -1 if the page ends first."""
        if at > self.last:
            return -1
        seen, look = [], at
        while look <= self.last and (m := _STOP.search(self.page, look)) and m.start() not in self.dead:
            if not m[1]:
                return m.end()
            seen.append(m.start())
            close = self.page.find(m[1], m.end())
            look = close + 1 if close >= 0 else m.end()
        self.dead.update(seen)
        return self.page.find(">", at) + 1

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element, or the page's end."""
        if self.raw_ends.get(tag) != len(self.page):
            m = re.compile(rf"</{tag}\s*>", re.I).search(self.page, at)
            self.raw_ends[tag] = m.end() if m else len(self.page)
        return self.raw_ends[tag]

    def pieces(self):
        """(text, end, tag, attributes) of the page in order: a text and then nothing, or a tag; a raw element is a tag of the name '' or ' '."""
        page, at, begin = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            head, after = page[at + 1 : at + 2], at + 1
            close = head == "/"
            m = _NAME.match(page, at + 2 if close else at + 1)
            tag, attributes = None, ""
            if page.startswith("<!--", at):
                after = page.find("-->", at + 4) + 3
                after = after if after > 2 else len(page)
            elif page.startswith("<![CDATA[", at):
                after = page.find("]]>", at) + 3
                after = after if after > 2 else len(page)
            elif head in ("!", "?"):
                after = page.find(">", at) + 1 or len(page)
            elif m:
                after = self.tag_end(m.end())
                tag = m[0].lower()
                if after <= 0:  # cut off: markup up to the next tag, or to the page's end
                    cut = page.find("<", m.end())
                    after, tag = cut if cut >= 0 else len(page), None
                else:
                    attributes = page[m.end() : after - 1]
                    if not close and tag in RAW:
                        after, tag = self.raw_end(tag, after), " " if tag in INSIDE else ""
            else:
                at += 1
                continue
            if at > begin:
                yield page[begin:at], False, None, ""
            at = begin = after
            if tag is not None:
                yield "", close, tag, attributes
        if begin < len(page):
            yield page[begin:], False, None, ""


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of the blocks of a page in order. A path names the open block elements and marks of their kinds.

    Text is decoded, its white space is one blank, and it is trimmed; empty blocks are left out. Ends that a page
    leaves out are implied as in HTML, and a tag that the page's end cuts off is markup, not text. Characters that names
    of elements don't have in HTML are underscores in paths, so any name can stand there. The time is in proportion to the page.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, path with it)
    held: dict[str, int] = {}  # open elements by tag
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if whole:
                out.append((stack[-1][1] if stack else "", whole))

    def push(tag: str, kind: str) -> None:
        name = _ODD.sub("_", tag)
        above = stack[-1][1] if stack else ""
        depth = above.count("/")
        mark = f"{name}!{kind}" if kind else name
        path = f"{above}/{mark}" if above else mark
        if depth >= DEEPEST and (not kind or depth >= 2 * DEEPEST or above.endswith("!" + kind)):
            path = above
        stack.append((tag, path))
        held[tag] = held.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop()[0]
        held[tag] -= 1
        return tag

    for piece, end, tag, attributes in _Scanner(page or "").pieces():
        if tag is None:
            text.append(piece)
            continue
        if tag in ("", " "):
            text.append(tag)
            continue
        if tag in INLINE:
            kind = "" if end or "=" not in attributes else _kind(tag, attributes)
            if kind in ("x", "c") and tag not in VOID:
                flush()
                push(tag, kind)
            elif end and held.get(tag):
                flush()
                while pop() != tag:
                    pass
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        if end:
            if held.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            pop()
        ends = SIBLINGS.get(tag, ())
        while stack and stack[-1][0] in ends:
            pop()
        push(tag, _kind(tag, attributes))
    flush()
    return out


def token(path: str, text: str) -> str:
    """The name of a block with its text: the path and the text's hash."""
    import hashlib

    return f"{path}={hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def may_be_template(path: str) -> bool:
    return not is_other(path) and not _HEADING.search(path)


def stream(found: list[tuple[str, str]], fixed: frozenset[str] = frozenset()) -> tuple:
    """The page's tokens as a wrapper: fixed ones by name, others as slots of their path, with repeated groups folded."""
    return fold(tuple(t if fixed and (t := token(p, x)) in fixed else p for p, x in found))


def fold(nodes: tuple) -> tuple:
    """Runs of equal neighbouring groups as ('+', group), shortest groups first."""
    for width in range(1, LONGEST_GROUP + 1):
        out: list = []
        i = 0
        while i < len(nodes):
            group = nodes[i : i + width]
            core = group[0][1] if width == 1 and isinstance(group[0], tuple) and group[0][0] == "+" else group
            j = i + width
            while len(group) == width and nodes[j : j + width] in (group, (("+", core),) if width == 1 else group):
                j += width
            if j > i + width:
                out.append(("+", core))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = tuple(out)
    return nodes


def _bare(node):
    """A node without its repeat and option marks, for alignment."""
    while isinstance(node, tuple) and node[0] in ("+", "?") and len(node[1]) == 1:
        node = node[1][0]
    return node


def _merged(a, b):
    """Of two nodes with the same core: repeated or optional if either is."""
    marks = {n[0] for n in (a, b) if isinstance(n, tuple)}
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] and len(a[1]) > 1:
        return a
    core = _bare(a)
    inner = core if not isinstance(core, tuple) else core
    if any(isinstance(n, tuple) and (n[0] == "+" or isinstance(n[1][0], tuple) and n[1][0][0] == "+") for n in (a, b)):
        inner = ("+", (core,)) if not (isinstance(core, tuple) and core[0] == "+") else core
    return ("?", (inner,)) if "?" in marks else inner


def align(a: tuple, b: tuple) -> tuple:
    """The union-free wrapper of two wrappers, whatever their length: a longest common subsequence of cores, the rest optional. Of
    two ways of equal length that with more fixed tokens is taken; a fixed token that meets a slot of its path becomes the slot."""
    if a == b:
        return a
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    head, tail, a, b = a[:lo], a[len(a) - end :], a[lo : len(a) - end], b[lo : len(b) - end]
    option = lambda n: n if isinstance(n, tuple) and n[0] == "?" else ("?", (n,))
    x, y = [_bare(n) for n in a], [_bare(n) for n in b]
    out, i, j = [], 0, 0
    for i_end, j_end, g in _ways(x, y):
        while i < i_end or j < j_end:
            if i < i_end:
                out.append(option(a[i]))
                i += 1
            else:
                out.append(option(b[j]))
                j += 1
        if g:
            out.append(_merged(a[i], b[j]) if x[i] == y[j] else _merged(_slotted(a[i]), _slotted(b[j])))
            i, j = i + 1, j + 1
    return fold((*head, *out, *tail))


def _ways(x: list, y: list):
    """Steps (i, j, gain) of the best alignment of two lists of cores in order: up to i and j all is optional, one list's alone at
    a time; where gain is above 0, x[i] and y[j] then meet.

    Rows of the table of best sums are made from the end. Of a table above CELLS only about the square root of all rows are kept,
    and those between two of them are made again when the way gets there, so that it takes some 2 * len(x) ** 0.5 * len(y) numbers.
    """
    import numpy as np

    numbers: dict = {}
    number = lambda n: numbers.setdefault(n, len(numbers))
    path = lambda n: n.partition("=")[0] if isinstance(n, str) else n
    cores = np.array([number(n) for n in y], np.int64)
    paths = np.array([number(("path", path(n))) for n in y], np.int64)
    whole, part = [number(n) for n in x], [number(("path", path(n))) for n in x]
    worth = [3 if "=" in n else 2 for n in x]

    def gains(i: int):
        return np.where(cores == whole[i], worth[i], paths == part[i]).astype(np.int32)

    def above(i: int, below):
        row = np.zeros(len(y) + 1, np.int32)
        most = np.maximum(below[:-1], gains(i) + below[1:])  # where nothing meets, the left one is the greater
        row[:-1] = np.maximum.accumulate(most[::-1])[::-1]
        return row

    step = 1 if len(x) * len(y) <= CELLS else max(1, int(len(x) ** 0.5))
    kept = {len(x): np.zeros(len(y) + 1, np.int32)}
    row = kept[len(x)]
    for i in range(len(x) - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    rows = kept if step == 1 else {}
    i = j = 0
    while i < len(x) and j < len(y):
        if i not in rows or i + 1 not in rows:
            last = min(len(x), i - i % step + step)
            rows = {last: kept[last]}
            for r in range(last - 1, i - 1, -1):
                rows[r] = above(r, rows[r + 1])
        here, below = rows[i], rows[i + 1]
        g = worth[i] if cores[j] == whole[i] else int(paths[j] == part[i])
        if g and here[j] == g + below[j + 1]:
            yield i, j, g
            i, j = i + 1, j + 1
        elif below[j] >= here[j + 1]:
            i += 1
            yield i, j, 0
        else:
            j += 1
            yield i, j, 0
    yield len(x), j, 0
    yield len(x), len(y), 0


def _slotted(node):
    """A node with slots in place of fixed tokens."""
    return (node[0], tuple(map(_slotted, node[1]))) if isinstance(node, tuple) else node.partition("=")[0]


def _places(wrapper: tuple):
    """(fixed token, whether it is in a repeated group) of a wrapper, in order."""
    for n in wrapper:
        if isinstance(n, str):
            if "=" in n:
                yield n, False
        else:
            for t, repeated in _places(n[1]):
                yield t, repeated or n[0] == "+"


def template(wrapper: tuple) -> list[str]:
    """The host's template in order: the fixed tokens that the wrapper has in one place alone, outside of repeated groups. That place may be an optional group, as some pages of a host, such as empty ones, are of no template."""
    places = list(_places(wrapper))
    count: dict[str, int] = {}
    for t, _ in places:
        count[t] = count.get(t, 0) + 1
    return [t for t, repeated in places if count[t] == 1 and not repeated]


def own_blocks(found: list[tuple[str, str]], anchors: list[str]) -> list[tuple[str, str]]:
    """The blocks of a page that its host's template doesn't meet. The page is matched against it by the most of its tokens that it has in order; one that has half of them or fewer doesn't match and keeps its blocks."""
    import bisect

    place = {t: i for i, t in enumerate(anchors)}
    paths = {t.partition("=")[0] for t in anchors}
    met = [(k, place[t]) for k, (p, x) in enumerate(found) if p in paths and (t := token(p, x)) in place]
    # longest rising run of places
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for m, (_, at) in enumerate(met):
        j = bisect.bisect_left(tails, at)
        before.append(ends[j - 1] if j else -1)
        if j == len(tails):
            tails.append(at)
            ends.append(m)
        else:
            tails[j], ends[j] = at, m
    if 2 * len(tails) <= len(anchors):
        return found
    gone, m = set(), ends[-1]
    while m >= 0:
        gone.add(met[m][0])
        m = before[m]
    return [b for k, b in enumerate(found) if k not in gone]


def shown(wrapper: tuple) -> str:
    """A wrapper as an expression: slots in braces, ? and + after groups."""
    return " ".join(f"({shown(n[1])}){n[0]}" if isinstance(n, tuple) else "{" + n + "}" for n in wrapper)


def slots(wrapper: tuple) -> set[str]:
    """The paths of a wrapper's slots and fixed tokens."""
    return set().union(*(slots(n[1]) if isinstance(n, tuple) else {n.partition("=")[0]} for n in wrapper)) if wrapper else set()


def _parse(text: str) -> tuple:
    """shown() undone."""
    nodes: list[list] = [[]]
    for token in re.findall(r"\{[^}]*\}|\(|\)[?+]", text):
        if token == "(":
            nodes.append([])
        elif token[0] == ")":
            group = tuple(nodes.pop())
            nodes[-1].append((token[1], group))
        else:
            nodes[-1].append(token[1:-1])
    return tuple(nodes[0])


def is_other(path: str) -> bool:
    """Whether a slot lies in reader comments anywhere, or in another element that isn't the main text inside of the innermost main element."""
    marks = path.split("/")
    if any(m.endswith("!c") for m in marks):
        return True
    last = max((i for i, m in enumerate(marks) if m.endswith("!m")), default=0)
    return any(m.endswith("!x") for m in marks[last:])


def main_root(weights: dict[str, int]) -> str:
    """The deepest path prefix with MOST of the characters of the given slots."""
    total, root = sum(weights.values()), ""
    while total:
        below: dict[str, int] = {}
        for path, n in weights.items():
            if path == root or not path.startswith(root):
                continue
            rest = path[len(root) :].lstrip("/")
            if "/" in rest:
                head = (root + "/" if root else "") + rest.split("/")[0]
                below[head] = below.get(head, 0) + n
        top = max(below, key=lambda k: (below[k], k), default=None)
        if top is None or below[top] < MOST * total:
            return root
        root = top
    return root


def is_main(path: str) -> bool:
    """Whether a slot is main text inside a main element."""
    return "!m" in path and any(m.endswith("!m") for m in path.split("/")) and not is_other(path)


def kept_slots(wrapper: tuple, weights: dict[str, int], varies: set[str]) -> set[str]:
    """The paths of a wrapper's slots that are main text: those in main elements, and those of pages without one, whose slots weights and varies are of."""
    main = {p for p in slots(wrapper) if is_main(p)}
    own = {p for p in slots(wrapper) if p in weights and not is_other(p)}
    text = {p: weights.get(p, 0) for p in own if p in varies} or {p: weights.get(p, 0) for p in own}
    root = main_root(text)
    return main | {p for p in own if not root or p == root or p.startswith(root + "/")}


def main_text(found: list[tuple[str, str]], kept: set[str], fixed: set[str]) -> str:
    """The text of a page's blocks that are main text. Kept slots are those of its kind, with a main element or without one.

    A page without a kept slot is of another template than most of its host's; its main text is below the deepest
    element with most of its own text in slots that aren't fixed.
    """
    if not any(is_main(p) for p, _ in found):
        if not any(p in kept for p, _ in found):
            own = [(p, t) for p, t in found if not is_other(p)]
            sizes: dict[str, int] = {}
            for p, t in [b for b in own if b[0] not in fixed] or own:
                sizes[p] = sizes.get(p, 0) + len(t)
            root = main_root(sizes)
            return "\n".join([t for p, t in own if not root or p == root or p.startswith(root + "/")])
        return "\n".join([t for p, t in found if p in kept and not is_main(p)])
    return "\n".join([t for p, t in found if p in kept and is_main(p)])


def host(url):
    """The host of a URL column, or an empty one."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def fixed_tokens(pages: DataFrame) -> DataFrame:
    """Written table host, tokens of pages(host, html): the texts that stand once on TEMPLATE_SHARE of a host's pages, and on TEMPLATE_PAGES or more, counted over all pages."""

    def scan(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            hosts, names = [], []
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                times = Counter(token(p, x) for p, x in blocks(page) if may_be_template(p))
                own = [t for t, n in times.items() if n == 1]
                hosts += [h] * (len(own) + 1)
                names += ["", *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.string())], names=["host", "token"])

    counted = common.written(pages.select("host", "html").mapInArrow(scan, "host string, token string").groupBy("host", "token").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES), "html-tokens")
    whole = counted.where("token = ''").select("host", F.col("n").alias("pages"))
    fixed = counted.where("token <> ''").join(whole, "host").where(F.col("n") >= F.col("pages") * TEMPLATE_SHARE).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    out = common.written(fixed, "html-fixed")  # no more tokens for a host than a page of it has blocks
    common.drop_written(counted)
    return out


def aligned(streams: DataFrame) -> DataFrame:
    """host, key (its wrapper) of streams(host, key, n): in parts of about FAN streams, and then what these give, until a host has one."""

    def join_streams(pdf):
        import pandas as pd

        wrapper: tuple | None = None
        for text in pdf.sort_values(["n", "key"], ascending=[False, True]).key:
            wrapper = _parse(text) if wrapper is None else align(wrapper, _parse(text))
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "key": [shown(wrapper or ())], "n": [int(pdf.n.sum())]})

    kind = "host string, key string, n long"
    while True:
        sizes = streams.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("parts"))
        cut = common.written(sizes.where("parts > 1").select(F.col("host").alias("h"), "parts"), "html-cut")
        n = cut.count()
        if not n:
            common.drop_written(cut)
            return streams.groupBy("host").applyInPandas(join_streams, kind)
        dealt = streams.join(common.small_side(cut, n), F.col("host") == F.col("h"), "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))).select("host", "key", "n", "part")
        made = common.written(dealt.groupBy("host", "part").applyInPandas(join_streams, kind).groupBy("host", "key").agg(F.sum("n").alias("n")), "html-parts")
        common.drop_written(cut, streams)
        streams = made


def infer(pages: DataFrame) -> DataFrame:
    """Written table host, wrapper (expression), anchors (the template's tokens), kept (paths), fixed (paths whose text is the same on all pages without a main element) of pages(url, html).

    Equal streams of a host are counted before they are gathered, so a host with a third of all pages sends its
    distinct folded streams only.
    """
    known = pages.select(host(F.col("url")).alias("host"), "html")
    fixed = fixed_tokens(known)
    n_fixed = fixed.count()

    def scan(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            rows: list[tuple] = []
            for h, page, names in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = blocks(page)
                rows.append((h, 0, shown(stream(found, frozenset(names or ()))), 0, 0))
                sizes: dict[str, list] = {}
                for p, t in found:
                    s = sizes.setdefault(p, [0, 0])
                    s[0] += len(t)
                    s[1] = zlib.crc32(t.encode("utf-8", "surrogatepass"), s[1])
                if not any(is_main(p) for p in sizes):
                    rows += [(h, 2, p, n, crc) for p, (n, crc) in sizes.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["host", "kind", "key", "chars", "crc"])

    told = known.join(common.small_side(fixed.select(F.col("host").alias("h"), "tokens"), n_fixed, 20_000), F.col("host") == F.col("h"), "left").select("host", "html", "tokens")
    seen = told.mapInArrow(scan, "host string, kind int, key string, chars long, crc long")
    counted = common.written(seen.groupBy("host", "kind", "key").agg(F.sum("chars").alias("chars"), F.min("crc").alias("low"), F.max("crc").alias("high"), F.count("*").alias("n")), "html-slots")
    whole = aligned(common.written(counted.where("kind = 0").select("host", "key", "n"), "html-streams"))

    def choose(key, left, right):
        import pandas as pd

        wrapper = _parse(left.key.iloc[0]) if len(left) else ()
        weights = dict(zip(right.key, right.chars, strict=True))
        varies = set(right.key[right.low != right.high])
        same = sorted(right.key[(right.low == right.high) & (right.n > 1)])
        return pd.DataFrame({"host": [key[0]], "wrapper": [shown(wrapper)], "anchors": [template(wrapper)], "kept": [sorted(kept_slots(wrapper, weights, varies))], "fixed": [same]})

    slots_of = counted.where("kind = 2").select(F.col("host").alias("h"), "key", "chars", "low", "high", "n")
    out = common.written(whole.groupBy("host").cogroup(slots_of.groupBy("h")).applyInPandas(choose, "host string, wrapper string, anchors array<string>, kept array<string>, fixed array<string>"), "html-wrappers")
    common.drop_written(counted, fixed)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html, ...).

    Null and empty html, and pages without main text, give an empty text. A null url's host is the empty one, whose
    pages share a wrapper. Repeated rows give repeated results; extra columns are ignored; very long pages are parsed
    whole; an empty table gives no rows. On a host of several templates, pages with a main element give its text and the
    others what main_text() finds in them. A host of fewer than TEMPLATE_PAGES pages has no template.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    wrappers = infer(pages)
    table = wrappers.select(F.col("host").alias("h"), "anchors", "kept", "fixed")
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(common.small_side(table, table.count(), 20_000), F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "anchors", "kept", "fixed")

    def write(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for page, anchors, kept, fixed in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                texts.append(main_text(own_blocks(blocks(page), anchors or []), set(kept or ()), set(fixed or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(write, "page_id long, url string, text string, n_chars long")
