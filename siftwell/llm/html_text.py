"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Every page of a host is aligned with the host's wrapper.  A square, the tokens of
one element, that follows its like becomes a repeated group; what only one side
has becomes an optional group; a text becomes a slot.  A slot counts its texts
and the different ones among them over all pages.  What varies from page to page
is content, and what repeats is the template: a page's main text is what the
element holds in which the host's varying text stands.  Elements without names
are told apart by what they hold: links, text alone, or blocks.  Tag and class
names decide only where slots cannot: on hosts without repetition, between an
element and the article around it, and for text that varies but is no article
(comments, forms).

What repeats chooses the main element but cuts nothing out of an article.  Only
a division of a neutral main element whose text is one and the same wherever it
stands, on two pages at least, is taken for a notice and left out; and where the
main element is the whole body, list items and cells that repeat.  Within the
main element names count as a whole (``ad``, not ``ad-hoc``) and on divisions and
lists only; single ``comment`` elements stay, repeated ones are readers' comments.
"""

from __future__ import annotations

import bisect
import html
import json
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import cut, give_back, pick, table

#: Hashes that a slot keeps to tell how many different texts it had; fewer are counted exactly.
KEPT = 24
#: Elements of a wrapper; of a larger one those that were seen least leave the expression, and only their slots are counted on.
WRAPPER_ELEMENTS = 5000
#: Hosts whose partial wrappers a task holds at a time.
HELD_HOSTS = 2000
#: Levels of nesting that are told apart; what is deeper counts to the last.
LEVELS = 120
#: Parts in which a host's partial wrappers are merged before they meet, and its pages dealt out where wrappers are not broadcast.
SALTS = 32
#: Bytes of wrappers' findings that are broadcast at most, after they were summed up.
BROADCAST_BYTES = 64_000_000
#: Share of the varying text that the main element holds of what its parent holds.
SHARE = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object|select|option)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
_BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar comment comments disqus respond replies cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended recommendations widget toolbar pagination pager skip hidden".split()
)
_OUTER_NAMES = frozenset({"header"})
#: Names that an element within the main element is left out for, as whole words of a class or id, and those that count only where the element repeats.
_CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsored promo comments comment-list commentlist disqus_thread respond replies "
    "sidebar menu navbar navigation breadcrumb breadcrumbs pagination newsletter subscribe share sharing social social-share related related-posts cookie-banner hidden".split()
)
_REPEATED_NAMES = frozenset("comment reply".split())
_CUT_TAGS = frozenset("div section ul ol span table".split())
#: Tags whose elements are told apart by what they hold, where they have no name.
_SHAPED = frozenset("div section td".split())


class Tag:
    __slots__ = ("close", "cut", "drop", "key", "name", "repeats")

    def __init__(self, name: str, attrs: str = "", close: bool = False):
        self.name, self.close, self.drop = name, close, name in _BOILERPLATE_TAGS
        self.cut, self.repeats = self.drop, False
        marks = []
        if attrs and not close:
            for m in _ATTR.finditer(attrs):
                kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                words = re.split(r"[^a-z0-9]+", value)
                if kind in ("class", "id"):
                    marks += [re.sub(r"\d{3,}", "0", w) for w in value.split()] if kind == "class" else []
                    self.drop |= not _BOILERPLATE_NAMES.isdisjoint(words) and name not in ("body", "html", "article", "main")
                    if name in _CUT_TAGS:
                        self.cut |= not _CUT_NAMES.isdisjoint(value.split())
                        self.repeats |= not _REPEATED_NAMES.isdisjoint(value.split())
                elif kind == "role":
                    self.drop |= value in _BOILERPLATE_ROLES
                    self.cut |= value in _BOILERPLATE_ROLES
                    marks.append(f"@{value}")
                elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                    self.drop = self.cut = True
                elif kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.drop = self.cut = True
        # an element that is dropped by name is another one than its like that is not
        self.key = ("</" if close else "<") + name + "".join(f".{w}" for w in sorted(set(marks))) + "!" * self.drop


def tokens(page: str | None) -> list[Tag | str]:
    """A page as a well-formed stream: tags that are missing are added, strays left out, texts still encoded."""
    out: list[Tag | str] = []
    stack: list[str] = []

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            out.append(Tag(stack.pop(), close=True))

    page = page or ""
    last = page.rfind(">") + 1  # no tag ends after it
    for m in _TOKEN.finditer(page, 0, last):
        text = m["text"]
        if text is not None:
            out.append(text)
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
        elif name in _VOID:
            out.append(Tag(name, m["attrs"]))
        else:
            if name not in _INLINE:
                depth = len(stack)
                while depth and (stack[depth - 1] in _INLINE or stack[depth - 1] == "p"):
                    depth -= 1
                close_to(depth)
                while stack and stack[-1] in _CLOSED_BY.get(name, ()):
                    close_to(len(stack) - 1)
            out.append(Tag(name, m["attrs"]))
            if not m["attrs"].rstrip().endswith("/") or name not in ("path", "use"):
                stack.append(name)
    if last < len(page):
        out.append(page[last:])
    close_to(0)
    _tell_apart(out)
    return out


def _tell_apart(stream: list[Tag | str]) -> None:
    """Adds to the keys of elements without names what they hold: L (mostly links), T (text alone), or P and the first block."""
    open_tags: list[list] = []  # element, characters, characters in links, first block within
    links = 0
    for x in stream:
        if not isinstance(x, Tag):
            if open_tags and (n := len(x) - x.count(" ")):
                open_tags[-1][1] += n
                open_tags[-1][2] += n if links else 0
        elif x.name == "a":
            links = max(0, links + (-1 if x.close else 1))
        elif x.name in _INLINE or x.name in _VOID:
            continue
        elif not x.close:
            if open_tags and open_tags[-1][3] is None:
                open_tags[-1][3] = x.name
            open_tags.append([x, 0, 0, None])
        elif open_tags:
            own, chars, linked, first = open_tags.pop()
            if open_tags:
                open_tags[-1][1] += chars
                open_tags[-1][2] += linked
            if own.name in _SHAPED and own.key.rstrip("!") == "<" + own.name and chars:
                own.key += "\tL" if 2 * linked >= chars else "\tT" if first is None else f"\tP{first}"


# ---- wrapper inference.  Nodes are lists, so that pages can be added to them:
# ["e", key, repeated, optional, count, children], ["s", "#", repeated, optional, count, text or None, characters, hashes], ["g", keys, repeated, optional, count, nodes]


def _slot(text: str) -> list:
    from xxhash import xxh64_intdigest

    return ["s", "#", False, False, 1, text, len(text), [xxh64_intdigest(text.encode(errors="replace"))]]


def page_tree(stream: list[Tag | str]) -> list:
    """A page's children of the root, from a well-formed stream.  Inline tags do not divide a text."""
    root: list = []
    stack, parts = [root], []

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            stack[-1].append(_slot(text))
        parts.clear()

    open_tags: list[bool] = []  # whether each open element has a node of its own, or counts to its parent
    for x in stream:
        if not isinstance(x, Tag):
            parts.append(x)
            continue
        if x.name in _INLINE:
            continue
        if x.name in _VOID:
            if x.name == "br":
                parts.append(" ")
            elif x.name == "hr":
                end()
            continue
        end()
        if x.close:
            if open_tags and open_tags.pop():
                stack.pop()
        elif len(stack) > LEVELS:
            open_tags.append(False)
        else:
            node = ["e", x.key, False, False, 1, []]
            stack[-1].append(node)
            stack.append(node[5])
            open_tags.append(True)
    end()
    return collapse(root)


def _pool(a: list, b: list, repeated: bool = False) -> list:
    """One node for two of the same key."""
    rep, opt, n = a[2] or b[2] or repeated, a[3] or b[3], a[4] + b[4]
    if a[0] == "s":
        hashes = a[7] if a[7] == b[7] else sorted({*a[7], *b[7]})[:KEPT]
        return ["s", "#", rep, opt, n, a[5] if a[5] == b[5] else None, a[6] + b[6], hashes]
    if a[0] == "e":
        return ["e", a[1], rep, opt, n, align(a[5], b[5])]
    return ["g", a[1], rep, opt, n, [_pool(x, y) for x, y in zip(a[5], b[5])]]


def collapse(nodes: list) -> list:
    """A sequence in which squares that follow their like are one repeated square, and likewise runs of two or three."""
    done: list = []
    for node in nodes:
        if node[0] == "e" and node[4] == 1:
            node[5] = collapse(node[5])
        done.append(node)
        again = True
        while again and len(done) > 1:
            again = False
            if done[-1][:2] == done[-2][:2]:
                last = done.pop()
                done[-1] = _pool(done[-1], last, repeated=True)
                again = True
                continue
            for k in (2, 3):
                keys = [x[1] for x in done[-k:]]
                if len(done) > k and done[-k - 1][0] == "g" and done[-k - 1][1] == keys:
                    last = done[-k:]
                    del done[-k:]
                    group = done[-1]
                    done[-1] = ["g", keys, True, group[3], group[4] + 1, [_pool(x, y) for x, y in zip(group[5], last)]]
                    again = True
                    break
                if len(done) >= 2 * k and [x[1] for x in done[-2 * k : -k]] == keys and not any(x[0] == "g" for x in done[-2 * k :]):
                    group = [_pool(x, y) for x, y in zip(done[-2 * k : -k], done[-k:])]
                    done[-2 * k :] = [["g", keys, True, False, 2, group]]
                    again = True
                    break
    return done


def _maybe(node: list) -> list:
    return [*node[:3], True, *node[4:]]


def _places(nodes: list) -> dict:
    out: dict = {}
    for k, x in enumerate(nodes):
        out.setdefault(str(x[1]), []).append(k)
    return out


def _next(places: dict, key, after: int) -> int | None:
    found = places.get(str(key), ())
    k = bisect.bisect_right(found, after)
    return found[k] if k < len(found) else None


def align(wrapper: list, other: list) -> list:
    """A sequence that covers both: what only one side has is optional."""
    if [x[:2] for x in wrapper] == [x[:2] for x in other]:
        return [_pool(x, y) for x, y in zip(wrapper, other)]
    ours, theirs = _places(wrapper), _places(other)
    done, i, j = [], 0, 0
    while i < len(wrapper) and j < len(other):
        w, o = wrapper[i], other[j]
        if w[:2] == o[:2]:
            done.append(_pool(w, o))
            i, j = i + 1, j + 1
            continue
        a, b = _next(ours, o[1], i), _next(theirs, w[1], j)
        if a is not None and (b is None or a - i <= b - j):
            done += map(_maybe, wrapper[i:a])
            i = a
        elif b is not None:
            done += map(_maybe, other[j:b])
            j = b
        else:
            done += [_maybe(w), _maybe(o)]
            i, j = i + 1, j + 1
    done += map(_maybe, wrapper[i:] or other[j:])
    return collapse(done)


def _elements(nodes: list) -> int:
    return sum(1 if x[0] == "s" else 1 + _elements(x[5]) for x in nodes)


def _without_rare(nodes: list, least: int, keys: tuple[str, ...], rare: dict) -> list:
    """Nodes that were seen ``least`` times; the slots of the others are counted on in ``rare`` by the keys above them."""
    out = []
    for x in nodes:
        if x[0] == "g":
            out.append(x)
        elif x[4] >= least:
            out.append([*x[:5], _without_rare(x[5], least, (*keys, x[1]), rare)] if x[0] == "e" else x)
        else:
            _count_slots([x], keys, rare)
    return out


def _count_slots(nodes: list, keys: tuple[str, ...], into: dict) -> None:
    """Adds each slot's texts, characters and kept hashes to those of the keys above it."""
    for x in nodes:
        if x[0] == "s":
            _add_slot(into, keys, x[4], x[6], x[7])
        else:
            _count_slots(x[5], (*keys, x[1]) if x[0] == "e" else keys, into)


def _add_slot(into: dict, keys: tuple[str, ...], n: int, chars: int, hashes: list[int]) -> None:
    seen = into.setdefault(keys, [0, 0, []])
    seen[:] = [seen[0] + n, seen[1] + chars, sorted({*seen[2], *hashes})[:KEPT]]


class Wrapper:
    """A host's wrapper, the number of its pages, and the slots that are no longer in the expression."""

    def __init__(self, nodes: list | None = None, pages: int = 0):
        self.nodes, self.pages, self.rare = nodes or [], pages, {}

    def add(self, nodes: list, pages: int = 1, rare: dict | None = None) -> None:
        self.nodes = align(self.nodes, nodes) if self.pages else nodes
        self.pages += pages
        for keys, seen in (rare or {}).items():
            _add_slot(self.rare, keys, *seen)
        least = 2
        while _elements(self.nodes) > WRAPPER_ELEMENTS:
            self.nodes = _without_rare(self.nodes, least, (), self.rare)
            least *= 2

    def slots(self) -> dict[tuple[str, ...], list]:
        """All slots by the keys above them: texts, characters and kept hashes, whatever the order of the pages."""
        found: dict[tuple[str, ...], list] = {}
        _count_slots(self.nodes, (), found)
        for keys, seen in self.rare.items():
            _add_slot(found, keys, *seen)
        return found

    def pack(self) -> bytes:
        return pickle.dumps((self.nodes, self.pages, self.rare))


def as_expression(nodes: list) -> str:
    """A wrapper in the form of a regular expression over tags, literal texts and slots."""
    out = []
    for x in nodes:
        if x[0] == "s":
            text = "#" if x[5] is None else json.dumps(x[5], ensure_ascii=False)
        elif x[0] == "e":
            text = " ".join(y for y in (x[1].split("\t")[0] + ">", as_expression(x[5]), f"</{_name(x[1])}>") if y)
        else:
            text = as_expression(x[5])
        mark = "*" if x[2] and x[3] else "+" * x[2] + "?" * x[3]
        out.append(f"({text}){mark}" if mark else text)
    return " ".join(out)


def _name(key: str) -> str:
    return re.split(r"[.!\t]", key.lstrip("</"), maxsplit=1)[0]


def path_id(parent: int, key: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(key, parent) >> 1


def _different(hashes: list[int]) -> float:
    return len(hashes) if len(hashes) < KEPT else (KEPT - 1) / (hashes[-1] / 2**64)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A slot repeats where this much fewer of its texts are different than in the host's slots that vary most.
REPEATS = 0.5


def findings(wrapper: Wrapper) -> tuple[dict[int, int], set[int], set[int]]:
    """Characters of varying text under each element, divisions that are notices (and, below 0, items that repeat), and elements kept against their names.

    An element is named by its path of keys.  Text that varies under a name of
    menus, comments and the like counts only where hardly any varies elsewhere:
    then the elements that hold it are kept.  All are empty where a host has one
    page, or copies of one.
    """
    slots: dict[int, list] = {}
    chains: dict[int, tuple[int, ...]] = {}
    named, articles, divisions, items = set(), set(), set(), set()
    for keys, seen in wrapper.slots().items():
        chain = [0]
        for key in keys:
            chain.append(path_id(chain[-1], key))
            if "!" in key:
                named.add(chain[-1])
            if _name(key) in ("article", "main") or ".@main" in key:
                articles.add(chain[-1])
        if keys and _name(keys[-1]) in ("div", "section"):
            divisions.add(chain[-1])
        if keys and _name(keys[-1]) in _ITEMS:
            items.add(chain[-1])
        slots[chain[-1]], chains[chain[-1]] = seen, tuple(chain)
    different = {path: _different(hashes) for path, (_, _, hashes) in slots.items()}
    rate = {path: different[path] / n for path, (n, _, _) in slots.items()}
    if wrapper.pages < 2 or all(r <= 1 / wrapper.pages for r in rate.values()):
        return {}, set(), set()
    outside = {path for path in slots if named.isdisjoint(chains[path])}

    def most_varied(among) -> float:
        whole = sum(slots[path][1] for path in among)
        return max((rate[path] for path in among if slots[path][1] >= 0.05 * whole), default=0)

    most = max(most_varied(outside), most_varied(slots))
    varied = {path for path in slots if rate[path] > REPEATS * most}
    whole, kept = sum(slots[path][1] for path in varied), set()
    if sum(slots[path][1] for path in varied & outside) < 0.1 * whole:
        under: dict[int, int] = {}
        for path in varied:
            for above in chains[path]:
                under[above] = under.get(above, 0) + slots[path][1]
        kept = {path for path in named if under.get(path, 0) >= SHARE * whole}
    mass: dict[int, int] = {}
    for path in varied:
        if named.isdisjoint(set(chains[path]) - kept):
            for above in chains[path]:
                mass[above] = mass.get(above, 0) + slots[path][1]
            mass[-path - 1] = slots[path][1]  # its own text
    alike = {path for path in divisions | items if different[path] == 1 and slots[path][0] > 1 and articles.isdisjoint(chains[path])}
    alike |= {path for path in items if slots[path][0] > 1 and rate[path] <= REPEATS * most and articles.isdisjoint(chains[path])}
    return mass, {path if path in divisions else -path - 1 for path in alike}, kept


def infer(pages: list[str | None]) -> Wrapper:
    """The wrapper of some pages of a host."""
    wrapper = Wrapper()
    for page in pages:
        wrapper.add(page_tree(tokens(page)))
    return wrapper


# ---- extraction

_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dt dd pre blockquote ul ol dl table tbody thead figure".split())
_GRID = frozenset("table tbody tr td th".split())
_BLOCKS = frozenset("div section p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote article main".split())
_ITEMS = frozenset("li td th dt dd".split())


def _is_header(key: str) -> bool:
    return _name(key) in _OUTER_NAMES or any(w in _OUTER_NAMES for w in key.split("\t")[0].rstrip("!").split(".")[1:])


class _Page:
    """A page's elements by path: name, key, children, and characters of text."""

    def __init__(self, stream: list[Tag | str], kept: set[int] | frozenset = frozenset()):
        self.keys: dict[int, str] = {0: "<"}
        self.children: dict[int, list[int]] = {0: []}
        self.chars: dict[int, int] = {}
        stack, drops, wraps = [0], [False], [False]
        for x in stream:
            if not isinstance(x, Tag):
                if not drops[-1] and (n := len(x) - x.count(" ")):
                    self.chars[stack[-1]] = self.chars.get(stack[-1], 0) + n
                continue
            if x.name in _INLINE or x.name in _VOID:
                continue
            if x.close:
                if len(stack) > 1:
                    stack.pop(), drops.pop(), wraps.pop()
                continue
            here = path_id(stack[-1], x.key) if len(stack) <= LEVELS else stack[-1]
            wraps.append(wraps[-1] or x.name in ("article", "main"))
            drops.append(drops[-1] or (x.drop and here not in kept) or (not wraps[-1] and _is_header(x.key)))
            if not drops[-1] and here not in self.keys:
                self.keys[here], self.children[here] = x.key, []
                self.children[stack[-1]].append(here)
            stack.append(here)

    def own_mass(self) -> dict[int, int]:
        """Characters under each element, for a page that is judged by itself."""
        mass: dict[int, int] = {}

        todo = [(0, False)]
        while todo:
            path, done = todo.pop()
            if not done:
                todo.append((path, True))
                todo += [(c, False) for c in self.children[path]]
            else:
                own = self.chars.get(path, 0)
                mass[path] = own + sum(mass[c] for c in self.children[path])
                mass[-path - 1] = own
        return mass

    def region(self, mass: dict[int, int]) -> int:
        """The element that holds the text of most weight: down from the root as long as one child has most of what is there.

        An article or a main element on the way is taken whole.
        """
        here = 0
        while True:
            among = [(mass.get(c, 0), -k, c) for k, c in enumerate(self.children[here])]
            whole = sum(m for m, _, _ in among) + mass.get(-here - 1, 0)
            best = max(among, default=(0, 0, 0))
            if not best[0] or best[0] < SHARE * whole:
                return here
            name = _name(self.keys[best[2]])
            if name in _LEAVES and not (name in _GRID and self._lays_out(best[2], mass)):
                return here
            here = best[2]
            if _name(self.keys[here]) in ("article", "main") or ".@main" in self.keys[here]:
                return here

    def _lays_out(self, path: int, mass: dict[int, int]) -> bool:
        """Whether the heaviest cell of a table holds blocks: the table is no data but a layout."""
        while self.children[path]:
            if _name(self.keys[path]) in ("td", "th"):
                return any(_name(self.keys[c]) in _BLOCKS for c in self.children[path])
            path = max(self.children[path], key=lambda c: mass.get(c, 0))
        return False

    def tagged(self) -> set[int]:
        """Articles, else main elements."""
        articles = {path for path, key in self.keys.items() if _name(key) == "article"}
        return articles or {path for path, key in self.keys.items() if _name(key) == "main" or ".@main" in key}


def main_text(page: str | None, mass: dict[int, int] | None = None, notices: set[int] | frozenset = frozenset(), kept: set[int] | frozenset = frozenset()) -> str:
    """Blocks of the main text, one a line.

    ``mass``, ``notices``, ``kept``: the findings of the host's wrapper; where they say
    nothing about this page, its own tags and text decide.
    """
    stream = tokens(page)
    if mass:
        own = _Page(stream, kept)
        if any(mass.get(-path - 1, 0) for path in own.keys):
            region = own.region(mass)
            return "\n".join(_blocks(stream, {region}, notices, kept, _name(own.keys[region]) in ("", "html", "body")))
    own = _Page(stream)
    tagged = own.tagged()
    region = None if tagged else own.region(own.own_mass())
    return "\n".join(_blocks(stream, tagged or {region}, frozenset(), frozenset(), not tagged and _name(own.keys[region]) in ("", "html", "body")))


def _blocks(stream: list[Tag | str], mains: set[int], notices, kept, whole: bool) -> list[str]:
    """Texts of the blocks inside the given elements.  ``whole``: they are the page's body, where only names tell what is no article."""
    paths, drops, inside, wraps = [0], [False], [0 in mains], [False]
    blocks, parts = [], []
    repeated = Counter(x.key for x in stream if isinstance(x, Tag) and x.repeats)

    def goes(x: Tag, path: int, wrapped: bool) -> bool:
        loose = whole and not wrapped and (x.drop or _is_header(x.key))
        return (x.cut or loose or repeated[x.key] > 1) and path not in kept

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and paths[-1] not in notices and not (whole and -paths[-1] - 1 in notices):
                blocks.append(text)
            parts.clear()

    for x in stream:
        if not isinstance(x, Tag):
            if inside[-1] and not drops[-1]:
                parts.append(x)
            continue
        if x.name in _INLINE:
            if not x.close:
                drops.append(drops[-1] or goes(x, -1, wraps[-1]))
            elif len(drops) > 1:
                drops.pop()
            continue
        if x.name in _VOID:
            if x.name == "br":
                parts.append(" ") if parts else None
            elif x.name not in ("wbr", "img"):
                end()
            continue
        end()
        if x.close:
            if len(paths) > 1:
                paths.pop(), drops.pop(), inside.pop(), wraps.pop()
            continue
        path = path_id(paths[-1], x.key) if len(paths) <= LEVELS else paths[-1]
        wraps.append(wraps[-1] or x.name in ("article", "main"))
        # what stands above the main element, whatever its name, holds it
        drops.append(drops[-1] or (inside[-1] and goes(x, path, wraps[-1])))
        paths.append(path)
        inside.append(inside[-1] or path in mains)
    end()
    return blocks


def host_of(url) -> F.Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``pages``, ``wrapper`` (an expression) and ``found`` (what it says of slots), from all pages of each host.

    Each task aligns the pages that it has, whatever their order; a host's
    partial wrappers are merged in SALTS parts and then together, so that no task
    sees more of a host than its wrappers.
    """
    rows = pick(pages, url=url_col, html=html_col).select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")

    def partial(batches):
        number, held = TaskContext.get().partitionId(), {}

        def let_go():
            names = list(held)
            out = pa.RecordBatch.from_pydict({"host": names, "salt": pa.array([number % SALTS] * len(names), pa.int32()), "pages": [held[h].pages for h in names], "wrapper": [held[h].pack() for h in names]})
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(host, Wrapper()).add(page_tree(tokens(page.as_py())))
                if len(held) > HELD_HOSTS:
                    yield let_go()
            give_back()
        if held:
            yield let_go()

    kind = "host string, salt int, pages long, wrapper binary"
    parts = cut(rows.mapInArrow(partial, kind))

    def merged(group: pa.Table) -> Wrapper:
        whole = Wrapper()
        for packed in sorted(group.column("wrapper").to_pylist()):
            whole.add(*pickle.loads(packed))
        return whole

    def some(group: pa.Table) -> pa.Table:
        whole = merged(group)
        return pa.table({"host": group.column("host")[:1], "salt": group.column("salt")[:1], "pages": [whole.pages], "wrapper": [whole.pack()]})

    def all_of(group: pa.Table) -> pa.Table:
        whole = merged(group)
        return pa.table({"host": group.column("host")[:1], "pages": [whole.pages], "wrapper": [as_expression(whole.nodes)], "found": [pickle.dumps(findings(whole))]})

    salted = parts.groupBy("host", "salt").applyInArrow(some, kind)
    return salted.groupBy("host").applyInArrow(all_of, "host string, pages long, wrapper string, found binary")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``text`` (blocks joined by line ends, empty if none) and ``n_chars`` of every page, with its id and url.

    A null or empty page has no text; a page without a host, or of which the
    host's wrapper says nothing, is judged by itself.  Up to BROADCAST_BYTES of
    findings the pages stay where they are; with more, a host's pages are dealt
    out in SALTS parts.  Repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored.
    """
    known = cut(wrappers(pages, url_col, html_col).select(F.col("host").alias("of"), "found"))
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.concat(F.lit(" "), F.xxhash64("id").cast("string"))))
    if (known.agg(F.sum(F.octet_length("found") + F.octet_length("of"))).head()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(known), F.col("host") == F.col("of"), "left")
    else:
        known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(known, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    joined = joined.select("id", "url", "html", "found")

    def work(batches):
        opened: dict[bytes, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = []
                for k in range(a, min(batch.num_rows, a + 500)):
                    found = batch.column(3)[k].as_py()
                    if found is not None and found not in opened:
                        if len(opened) > 1000:
                            opened.clear()
                        opened[found] = pickle.loads(found)
                    texts.append(main_text(batch.column(2)[k].as_py(), *(opened[found] if found is not None else ())))
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, n))],
                    ["id", "url", "text", "n_chars"],
                )
            give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(work, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
