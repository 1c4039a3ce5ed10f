"""HTML extraction with wrappers inferred as union-free regular expressions.

A page is a stream of tags and texts. Pages of one host come from one template, so aligning their streams
tells the template from what fills it: tags that match stay, a text that is the same stays as it is, a text that differs
becomes a slot, a run of tags that only some pages have becomes optional, and a run that repeats in differing numbers becomes
a repeated group. The result, built from all pages of a host, has sequence, option and repetition but no
union, and so is itself a regular expression over tags and texts, matched without backtracking. Streams are dealt to parts by hash; a part's wrapper
grows by each page that it doesn't match, and the parts' wrappers are aligned with each other, PARTS at a time, until a host has one.

A page that marks its article (``article``, ``main`` or the role ``main``) is read from that element. On other pages the
wrapper tells what fills the template: a text that stands at its place in SEEN or more pages of the host is the template's and is left
out, while slots, options and groups hold the page's own texts. Of these, elements that are never
part of an article (by name, or by a class or role of such words) are left out too.
A page that its host's wrapper doesn't match (or that has no host, or whose host has too few pages that differ) is read by the rules for
elements alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fresh, slices, table, texts
from edgeloom.session import BROADCAST_ROWS, dropped, join_counted, stored

#: Items of all pages of a part of a host, about, and parts whose wrappers are aligned at once.
ITEMS, PARTS = 200_000, 16
#: Cells of an alignment's table that are held at a time for each level of it; its time grows with the product of both lengths.
CELLS = 8_000_000
#: Pages of the host that must have a text at its place before it is the template's.
SEEN = 3
#: Pages that have more than this part of their text in common with all others count as one, as do those with the same longest text of their own: what copies share is no template.
COPIES = 0.5
#: Bytes of wrappers that are broadcast, and wrappers that a Python worker keeps ready.
WRAPPER_BYTES, READY = 32 << 20, 300

# Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea input label fieldset dialog menu option datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
UNBROKEN = frozenset("script style noscript template svg math iframe object canvas audio video map base link meta param source track".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A class, id or role that marks what is not the article: one of these words, with a place before it and a shape after it.
MARKS = re.compile(
    r"(?:(?:site|page|global|main|top|left|right|bottom|mid|wp|block|js|post|article|entry|user|reader|is|c|m|o)[-_]+)?"
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|consent|complementary|contentinfo|cookies?|disqus|gdpr|menu|nav|navbar|navigation|"
    r"newsletter|notices?|notification|pagination|pager|popup|modal|promo|promoted|promotion|recommended|related|respond|replies|search|share|sharing|sidebar|skip|social|sponsor|sponsored|"
    r"subscribe|subscription|toolbar|topbar|alert|masthead)"
    r"(?:[-_]*(?:bar|body|box|block|wrapper|wrap|container|content|list|section|area|inner|slot|unit|banner|top|bottom|left|right|item|items|link|links|widget|form|thread|text|message|posts|articles|stories|buttons|overlay|header|footer|main|primary|secondary|menu|\d+))*",
    re.I,
).fullmatch
#: Those that hold only for the frame of a page.
FRAME = re.compile(r"(?:(?:site|page|global|main|top|bottom)[-_]*)?(?:header|footer|colophon)(?:[-_]*(?:bar|inner|wrapper|container|main|top|bottom|\d+))*", re.I).fullmatch
#: Those that hold for an article element too.
REMARKS = re.compile(r"(?:reader|user)?[-_]*(?:comments?|related|promo|promoted|sponsored|advert|ad|recommended)(?:[-_]*(?:body|item|box|list|wrapper|\d+))*", re.I).fullmatch
_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_name = re.compile(r"</?([A-Za-z][^\s/>]*)")
_attribute = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_hidden_style = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest): '<' opens, '>' closes, '#' is text, its references decoded; comments, declarations and what hidden elements hold are left out.

    A reference ends where its text does: what stands after a tag or a comment is no part of it. A tag whose quote is never closed ends at the next '>'.
    """
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(page)
    while at < n:
        m = _token.match(page, at)
        raw = m.group()
        at = m.end()
        if raw[0] != "<" or len(raw) == 1:
            raw = html.unescape(raw)
            if out and out[-1][0] == "#":
                out[-1] = ("#", "", out[-1][2] + raw)
            else:
                out.append(("#", "", raw))
            continue
        if raw[1] in "!?":
            if raw.startswith("<![CDATA["):
                out.append(("#", "", raw[9:].removesuffix("]]>")))
            continue
        name = _name.match(raw)[1].lower()
        if raw[1] == "/":
            out.append((">", name, ""))
            continue
        out.append(("<", name, raw[len(name) + 1 : -1]))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    return out


def marks(rest: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether they mark what is not the article."""
    if not rest or "=" not in rest and "hidden" not in rest.lower():
        return "", False
    said, bad = [], False
    for m in _attribute.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            if key != "id":
                said.append(value)
            bad |= any(MARKS(x) for x in value.split())
        else:
            bad |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(_hidden_style.search(value))
    return " ".join(sorted(" ".join(said).split())), bad


def stream(toks: list[tuple[str, str, str]], places: list[list[int]] | None = None) -> list[str]:
    """Tokens as an alphabet: a text is '#' and a hash of it, tags have their class and role; white space is nothing.

    ``places`` is filled with the tokens that each item stands for.
    """
    out: list[str] = []
    for i, (kind, name, rest) in enumerate(toks):
        if kind == "#":
            words = rest.split()
            if not words:
                continue
            if out and out[-1][0] == "#":
                out[-1] = "#" + _sense(out[-1] + " ".join(words))
                if places is not None:
                    places[-1].append(i)
                continue
            out.append("#" + _sense(" ".join(words)))
        else:
            out.append(f"{kind}{name}" + (f".{marks(rest)[0]}" if kind == "<" and rest else ""))
        if places is not None:
            places.append([i])
    return out


def _sense(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


# A wrapper is a list of items: a tag, '#' for a slot, '#' and a hash for a text of the template, ["?", items] for an option,
# ["+", items] for a repeated group, or ["+", items, run] for a group of which every page so far has just this run.


def _shape(item) -> str:
    """What must be equal for two items to match: a tag, or the tags of a group without its options."""
    if isinstance(item, str):
        return "#" if item[0] == "#" else item
    return item[0] + _body(item)


def _body(item) -> str:
    return "".join(_shape(x) for x in item[1] if isinstance(x, str) or x[0] == "+")


def _ids(items: list, known: dict[str, int]) -> np.ndarray:
    return np.array([known.setdefault(_shape(x), len(known)) for x in items], np.int64)


def _flat(items: list) -> list[str] | None:
    """The run of tags and texts that items stand for, if they have one."""
    out: list[str] = []
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif x[0] == "+" and len(x) == 3:
            out += x[2]
        else:
            return None
    return out


def _merged(x, y):
    """One item for two that match."""
    if isinstance(x, str):
        return x if x == y else "#"
    run = x[2:] if len(x) == 3 and x[2:] == y[2:] else []
    return ["+", aligned(x[1], y[1]), *run]


def folded(items: list) -> list:
    """Neighbouring repeats made repeated groups, the shortest first; their texts may differ."""
    ids, p = _ids(items, known := {}), 1
    while 2 * p <= len(items):
        ends = np.empty(0, int)
        if (ids[:-p:p] == ids[p::p]).any():  # p equal items in a row have a multiple of p among them
            same = ids[:-p] == ids[p:]
            ends = np.append(np.flatnonzero(~same), len(same))
        if len(ends) and np.diff(ends, prepend=-1).max() > p:
            run = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))
            if (run >= p).any():
                out: list = []
                i = 0
                while i < len(items):
                    n = int(run[i]) // p + 1 if i < len(run) else 1
                    if n > 1 and not (p == 1 and isinstance(items[i], list)):
                        units = [items[i + k * p : i + (k + 1) * p] for k in range(n)]
                        unit = units[0]
                        for u in units[1:]:
                            unit = [_merged(x, y) for x, y in zip(unit, u)]
                        flat = _flat(items[i : i + n * p])
                        out.append(["+", unit, flat] if flat and any(len(x) > 1 and x[0] == "#" for x in flat) else ["+", unit])
                        i += n * p
                    else:
                        out.append(items[i])
                        i += 1
                items = out
                ids = _ids(items, known)
        p += 1
    return items


def _from_the_last(n: int, row, last: np.ndarray, most: int):
    """Rows 0 to n of a table where ``row(i, below)`` makes a row of the one below it and the last is given, the first row first.

    Where there are more than ``most``, only some are kept and the rows between are made again, so about ``most`` are held at each level.
    """

    def between(lo, hi, below):
        every = 1
        while hi - lo > most * every:
            every *= most
        kept = {}
        r = below
        for i in range(hi - 1, lo - 1, -1):
            r = row(i, r)
            if (i - lo) % every == 0:
                kept[i] = r
        for i in range(lo, hi, every):
            if every == 1:
                yield kept.pop(i)
            else:
                yield from between(i, min(i + every, hi), kept.get(i + every, below))
                kept.pop(i, None)

    yield from between(0, n, last)
    yield last


def aligned(a: list, b: list) -> list:
    """One wrapper for what two match: equal items stay, texts that differ are slots, what only one has is optional."""
    plain = lambda x: x[1] if isinstance(x, list) and x[0] == "?" else [x]
    one = [(y, isinstance(x, list) and x[0] == "?") for x in a for y in plain(x)]
    two = [(y, isinstance(x, list) and x[0] == "?") for x in b for y in plain(x)]
    # a group and one unit of it are the same thing more than once and once
    for mine, other in ((one, two), (two, one)):
        for g in {_shape(x): x for x, _ in mine if isinstance(x, list)}.values():
            unit, p = [_shape(x) for x in g[1]], len(g[1])
            shapes, i = [_shape(x) for x, _ in other], 0
            while i + p <= len(other):
                if shapes[i : i + p] == unit:
                    found = [x for x, _ in other[i : i + p]]
                    flat = _flat(found)
                    other[i : i + p] = [(["+", found, *([flat] if flat else [])], any(o for _, o in other[i : i + p]))]
                    shapes[i : i + p] = [_shape(g)]
                i += 1
    n, m = len(one), len(two)
    left, right = [x for x, _ in one], [x for x, _ in two]
    x, y = _ids(left, known := {}), _ids(right, known)
    texts_: dict[str, int] = {}
    text = lambda items: np.array([texts_.setdefault(t, len(texts_)) if isinstance(t, str) and t[0] == "#" and len(t) > 1 else -1 for t in items], np.int64)
    s, t = text(left), text(right)

    def best(i: int, below: np.ndarray) -> np.ndarray:
        """The longest match of what follows in both, equal texts before others, for item i and each place in the other."""
        hit = np.where(y == x[i], np.where((t == s[i]) | (s[i] < 0), 3, 2), -1)
        row = np.zeros(m + 1, np.int32)
        row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(hit > 0, below[1:] + hit, 0))[::-1])[::-1]
        return row

    rows = _from_the_last(n, best, np.zeros(m + 1, np.int32), max(2, CELLS // (m + 1)))
    at, below = next(rows), next(rows, None)
    out: list = []
    i = j = 0
    closed = True

    def maybe(x):
        nonlocal closed
        if out and isinstance(out[-1], list) and out[-1][0] == "?" and not closed:
            out[-1][1].append(x)
        else:
            out.append(["?", [x]])
        closed = False

    while i < n or j < m:
        hit = 0
        if i < n and j < m and x[i] == y[j]:
            hit = 3 if s[i] < 0 or s[i] == t[j] else 2
        if hit and at[j] == below[j + 1] + hit:
            both = _merged(left[i], right[j])
            if one[i][1] or two[j][1]:
                closed = True
                maybe(both)
            else:
                out.append(both)
            closed = True
            i, j = i + 1, j + 1
            at, below = below, next(rows, None)
        elif j >= m or i < n and below[j] >= at[j + 1]:
            maybe(left[i])
            i += 1
            at, below = below, next(rows, None)
            closed = i >= n or (j < m and x[i] == y[j])
        else:
            maybe(right[j])
            j += 1
            closed = j >= m or (i < n and x[i] == y[j])
    return out


def _sized(page: str) -> tuple[list[str], list[int]]:
    """The stream of a page, and how long each item's text is, 0 for tags."""
    toks, places = tokens(page), []
    items = stream(toks, places)
    return items, [sum(len(toks[i][2]) for i in at) if x[0] == "#" else 0 for x, at in zip(items, places)]


def learned(streams: list[list[str]]) -> list:
    """One wrapper for some pages: each that the wrapper so far doesn't match is aligned with it, in the order given."""
    wrapper: list = []
    ready: Wrapper | None = None
    for s in streams:
        if not s or ready and ready.fits(s):
            continue
        items = folded(s)
        wrapper = folded(aligned(wrapper, items)) if wrapper else items
        ready = Wrapper(wrapper)
    return wrapper


def joined(wrappers: list[list]) -> list:
    """One wrapper for those of the parts of a host."""
    out: list = []
    for w in wrappers:
        out = folded(aligned(out, w)) if out and w and w != out else out or w
    return out


def evidence(ready: Wrapper, items: list[str], sizes: list[int]) -> tuple[list[str], str]:
    """Texts of a page that stand at their place in its wrapper, and what tells this page from its copies: its longest text of its own."""
    at = set(ready.constants(items))
    own = [(n, x) for i, (x, n) in enumerate(zip(items, sizes)) if x[0] == "#" and i not in at]
    alone = sum(n for n, _ in own) >= (1 - COPIES) * sum(sizes) and own
    return list({items[i] for i in at}), max(own)[1] if alone else ""


def inferred(pages: list[str]) -> list:
    """The wrapper of some pages of one host."""
    sized = [x for x in map(_sized, pages) if x[0]]
    wrapper = learned([s for s, _ in sized])
    ready = Wrapper(wrapper)
    seen: dict[str, set[str]] = {}
    for s, n in sized:
        found, page = evidence(ready, s, n)
        for t in found:
            seen.setdefault(t, set()).add(page)
    return _settled(wrapper, {t for t, who in seen.items() if len(who) >= SEEN})


def _settled(items: list, known: set[str]) -> list:
    """A wrapper whose texts are those in ``known``, others being slots; a run without any is its group."""
    out: list = []
    for x in items:
        if isinstance(x, str):
            out.append("#" if x[0] == "#" and x not in known else x)
        elif len(x) == 3 and any(t in known for t in x[2]):
            out.append(["+", _settled(x[1], known), _settled(x[2], known)])
        else:
            out.append([x[0], _settled(x[1], known)])
    return out


#: Letters of texts (the first stands for any other text) and of tags, in the private planes, and how many each has.
_TEXT, _TAG, _LETTERS = 0xF0000, 0x100000, 0xFFFE


def _strings(items: list) -> set[str]:
    return {y for x in items for y in ([x] if isinstance(x, str) else set().union(*map(_strings, x[1:])))}


class Wrapper:
    """A wrapper made ready to match pages. An item is one letter, or two where there are more items than letters."""

    def __init__(self, items: list):
        self.width = 1 if len(_strings(items)) < _LETTERS else 2
        self.letters: dict[str, str] = {"#": chr(_TEXT) * self.width}
        self.match = regex.compile(self._pattern(items)).fullmatch if items else None
        self.fixed = len([x for x in self.letters if x[0] == "#"]) > 1

    def _letter(self, x: str) -> str:
        if x not in self.letters:
            plane, k = _TEXT if x[0] == "#" else _TAG, len(self.letters)
            self.letters[x] = chr(plane + k) if self.width == 1 else chr(plane + k // _LETTERS) + chr(_TEXT + k % _LETTERS)
        return self.letters[x]

    def _pattern(self, items: list) -> str:
        out = []
        for x in items:
            if isinstance(x, list):
                out.append(self._pattern(x[2]) if len(x) == 3 else f"(?:{self._pattern(x[1])}){x[0]}+")
            elif x == "#":
                out.append(f"[{chr(_TEXT)}-{chr(_TAG - 1)}]" * self.width)
            else:
                letter = self._letter(x)
                out.append(f"(?P<fixed>{letter})" if x[0] == "#" else letter)
        return "".join(out)

    def _matched(self, page: list[str]):
        other, none = self.letters["#"], chr(0) * self.width
        return self.match("".join(self.letters.get(x) or (other if x[0] == "#" else none) for x in page)) if self.match else None

    def fits(self, page: list[str]) -> bool:
        return self._matched(page) is not None

    def constants(self, page: list[str]) -> list[int]:
        """Places of the texts of a page that are the template's; none if the page doesn't fit."""
        m = self._matched(page) if self.fixed else None
        return [a // self.width for a, _ in m.spans("fixed")] if m else []


def _around(toks: list[tuple[str, str, str]]) -> set[int]:
    """Forms, and their fieldsets, that hold an article, a main element or a first heading."""
    found: set[int] = set()
    open_: list[tuple[str, int]] = []
    for i, (kind, name, rest) in enumerate(toks):
        if name in ("form", "fieldset"):
            if kind == "<":
                open_.append((name, i))
            else:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        del open_[k:]
                        break
        elif open_ and kind == "<" and (name in ("article", "main", "h1") or rest and "main" in marks(rest)[0].split()):
            found.update(k for _, k in open_)
    return found


def article(page: str, wrapper: Wrapper | None = None) -> str:
    """The main text of a page: blocks in page order, one per line.

    A form is left out unless it is wrapped around the page: around its article, or a heading of the first order.
    """
    toks = tokens(page)
    around = _around(toks)
    names = {name for kind, name, _ in toks if kind == "<"}
    roles = any(kind == "<" and "main" in marks(rest)[0].split() for kind, _, rest in toks if rest and "role" in rest.lower())
    main = "article" if "article" in names else "main" if "main" in names else "role" if roles else None
    template: set[int] = set()
    if main is None and wrapper and wrapper.fixed:
        places: list[list[int]] = []
        items = stream(toks, places)
        template = {i for k in wrapper.constants(items) for i in places[k]}
    blocks: list[str] = []
    current: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, is boilerplate, is in the article
    skip, inside = False, main is None

    def flush():
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    for i, (kind, name, rest) in enumerate(toks):
        if kind == "#":
            if inside and not skip and i not in template:
                current.append(rest)
            continue
        if kind == "<":
            if name not in INLINE and name not in UNBROKEN:
                flush()
            if name in CLOSES_P and any(s[0] == "p" for s in stack[-4:]):
                while stack and stack[-1][0] in INLINE:
                    stack.pop()
                if stack and stack[-1][0] == "p":
                    stack.pop()
                skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, main is None)
            if name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                stack.pop()
                skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, main is None)
            if name == "br":
                current.append(" ")
            if name in VOID or rest.endswith("/") and name in ("svg", "path", "br"):
                continue
            said, bad = marks(rest)
            is_main = name == main or main == "role" and "main" in said.split()
            frame = name == "header" or name == "div" and any(map(FRAME, said.split()))
            header = frame and (not inside or main is None and not any(s[0] in ("article", "section") for s in stack))
            bad = bad and name not in ("html", "body", "article", "main") and not is_main
            bad = bad or name == "article" and any(map(REMARKS, said.split()))
            skip = skip or name in HIDDEN or name in BOILERPLATE and i not in around or header or bad
            inside = inside or is_main
            stack.append((name, skip, inside))
        else:
            if name not in INLINE and name not in UNBROKEN:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "table", "nav", "footer", "aside") and name in INLINE | {"p", "li"}:
                    break
            skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, main is None)
    flush()
    return "\n".join(blocks)


def _streams(batches):
    """The streams of pages, in parts of a batch."""
    for batch in batches:
        for t in slices(batch, batch.schema.get_field_index("html")):
            found = [_sized(p) for p in t.column("html").to_pylist()]
            items = pa.array([x for x, _ in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([t.column("host"), t.column("h"), items, pa.array([n for _, n in found], pa.list_(pa.int32())), pa.array([len(x) for x, _ in found], pa.int64())], ["host", "h", "items", "sizes", "n"])


def _learn(t: pa.Table) -> pa.Table:
    order = sorted(zip(t.column("h").to_pylist(), t.column("items").to_pylist()))
    return pa.table([t.column("host").slice(0, 1), t.column("part").slice(0, 1), pa.array([json.dumps(learned([x for _, x in order]))])], ["host", "part", "wrapper"])


def _join(t: pa.Table) -> pa.Table:
    t = t.sort_by("part")
    wrappers = [json.loads(w) for w in t.column("wrapper").to_pylist()]
    return pa.table([t.column("host").slice(0, 1), t.column("up").slice(0, 1), pa.array([json.dumps(joined(wrappers))])], ["host", "part", "wrapper"])


class _Ready(dict):
    """Wrappers by their JSON, made ready; emptied when it holds READY."""

    def __missing__(self, w: str) -> Wrapper:
        if len(self) >= READY:
            self.clear()
        self[w] = Wrapper(json.loads(w))
        return self[w]


def _count(batches):
    """``(host, text, page)``: texts at their place, with SEEN pages a batch at most, as more don't matter."""
    held = _Ready()
    for t in batches:
        seen: dict[tuple[str, str], set[str]] = {}
        columns = [t.column(c).to_pylist() for c in ("host", "wrapper", "items", "sizes")]
        for host, w, items, sizes in sorted(zip(*columns), key=lambda r: r[1]):  # pages of one wrapper together
            found, page = evidence(held[w], items, sizes)
            for x in found:
                who = seen.setdefault((host, x), set())
                if len(who) < SEEN:
                    who.add(page)
        rows = [(*k, p) for k, who in seen.items() for p in who]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["host", "text", "page"])


def wrappers_of(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of all ``(host, h, html)``, where ``h`` is a hash of a page's key: wrappers in JSON, those without a text of the template left out.

    A page is turned into a stream once, which is stored. Neither the parts nor their order depend on how Spark cuts the table.
    """
    streams = stored(pages.mapInArrow(_streams, "host string, h long, items array<string>, sizes array<int>, n long"), "html-streams").where("n > 0")
    hosts = stored(streams.groupBy("host").agg(F.ceil(F.sum("n") / ITEMS).cast("long").alias("parts")), "html-hosts")
    n, most = hosts.agg(F.count("*"), F.coalesce(F.max("parts"), F.lit(0))).first()
    dealt = join_counted(streams, hosts, ["host"], n).select("host", F.pmod("h", F.col("parts")).alias("part"), "h", "items")
    found = dealt.groupBy("host", "part").applyInArrow(_learn, "host string, part long, wrapper string")
    while most > 1:
        found = found.withColumn("up", F.floor(F.col("part") / PARTS)).groupBy("host", "up").applyInArrow(_join, "host string, part long, wrapper string")
        most = -(-most // PARTS)
    found = stored(found.where("wrapper <> '[]'").select("host", "wrapper"), "html-learned")
    size = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    seen = join_counted(streams, found, ["host"], n if size <= WRAPPER_BYTES else BROADCAST_ROWS + 1).select("host", "wrapper", "items", "sizes").mapInArrow(_count, "host string, text string, page string")
    known = seen.distinct().groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).groupBy("host").agg(F.collect_list("text").alias("known"))

    def settle(wrapper: pa.Array, texts_: pa.Array) -> pa.Array:
        return pa.array([json.dumps(_settled(json.loads(w), set(k))) for w, k in zip(wrapper.to_pylist(), texts_.to_pylist())], pa.string())

    out = stored(found.join(known, "host").select("host", F.arrow_udf(settle, "string")("wrapper", "known").alias("wrapper")), "html-wrappers")
    dropped(streams, hosts, found)
    return out


def host_of(url):
    """The host of a URL, in lower case; null without one."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text`` (the main text) and ``n_chars`` (its code points).

    A null or empty page has an empty text. Character references are decoded, white space inside a block
    becomes one space, blocks are joined by one line feed; no block is dropped for its words. Pages of any length and with broken markup are read whole. A page with a null or odd
    URL is read without a wrapper. All others, of any length, are learned from and counted, in hash order of their keys, equal ones by
    their streams. Repeated rows agree; an empty table stays empty; columns that have the new names are replaced.
    """
    kept = [c for c in pages.columns if c not in (text, "n_chars")]
    host, found = fresh(pages, "host", "wrapper")
    base = pages.withColumn(host, host_of(F.col(url)))
    some = base.where(F.col(host).isNotNull() & (F.col(page) != "")).select(F.col(host).alias("host"), F.xxhash64(F.lit(9), key).alias("h"), F.col(page).alias("html"))
    wrappers = wrappers_of(some)
    n, size = wrappers.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()
    held = _Ready()

    def read(html_: pa.Array, wrapper: pa.Array) -> pa.Array:
        page_of, wrapper_of = texts(html_), wrapper.to_pylist()
        out = [""] * len(page_of)
        for i in sorted(range(len(out)), key=lambda i: wrapper_of[i] or ""):  # pages of one wrapper together
            w = wrapper_of[i]
            out[i] = article(page_of[i], held[w] if w is not None else None) if page_of[i] else ""
        return pa.array(out, pa.string())

    out = join_counted(base, wrappers.toDF(host, found), [host], n if size <= WRAPPER_BYTES else BROADCAST_ROWS + 1, "left")
    main = F.arrow_udf(read, "string")(F.col(page), F.col(found))
    return out.select(*kept, main.alias(text)).withColumn("n_chars", F.char_length(text).cast("long"))


def op8_html_text(spark, sf_dir) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
