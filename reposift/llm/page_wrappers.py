"""Wrappers of web pages: union-free regular expressions over the pages of a host, inferred by alignment.

A page is a stream of tags and texts. Its expression has, for every element that holds text, the
sequence of its parts, each once, optional, or repeated, and slots for texts. The expressions
of a host's pages are aligned one after the other: parts that both have are aligned in turn, a part
that one lacks becomes optional, one that comes again a repetition, a stretch in another order a
repeated group of optional parts, and a text that differs a slot. No alternatives are needed, and
every page of the host matches. The slots of the finished wrapper, told by their place in it, are
the article's, or the page's frame, and so are texts that a slot has on all pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

# Fixed values of HTML: elements without an end tag, elements whose content is not markup, elements
# that begin a new block, and those that a new one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option"
    " p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}

# What the frame of a page is marked by, as elements, roles, and words of classes and
# ids; the words that also mark an article itself as something else; and what the main part is marked by.
FRAME_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea title iframe object"
    " svg math canvas audio video map dialog menu search noembed noframes xmp".split()
)
FRAME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice"
    " notices overlay pager pagination popup promo promotion related reply replies respond share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo related reply replies sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Labels that a path has at most; what is nested deeper counts as part of the last one.
DEPTH = 32

# Different pages that a wrapper must come from before equal texts count as part of the frame.
SEEN = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attributes2>[^>]*)>|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class Piece(NamedTuple):
    """A text of a page: labels of the elements around it with their numbers, its block, itself."""

    path: tuple[tuple[str, int], ...]
    block: int
    text: str


def _label(tag: str, attributes: str, inside_main: bool) -> str:
    """The element's name, and ``!`` if it belongs to the frame, or ``*`` if it is marked as the main part."""
    words: set[str] = set()
    role = ""
    for found in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value = (found[2] or found[3] or found[4] or "").lower()
        if found[1].lower() == "role":
            role = value.strip()
        else:
            words.update(re.split("[^a-z0-9]+", value))
    if tag in ("html", "body"):
        return tag
    if tag == "article":
        return "article!" if words & ARTICLE_WORDS else "article"
    if tag == "main" or role == "main":
        return f"{tag}*"
    if tag in FRAME_TAGS or role in FRAME_ROLES or words & FRAME_WORDS:
        return f"{tag}!"
    if tag == "header" or "header" in words and not inside_main and tag not in HEADINGS:
        # An article's own header holds its heading, and nothing else of it.
        return "header?" if inside_main and tag == "header" else f"{tag}!"
    return tag


def pieces_of(page: str | None) -> list[Piece]:
    """The texts of a page with their places, in order. Character references are decoded."""
    pieces: list[Piece] = []
    stack: list[tuple[str, str | None, int]] = []  # element, label in the path or None, number
    path: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    block, number, main_depth = 0, 0, 0

    def pop() -> None:
        nonlocal main_depth
        tag, label, _ = stack.pop()
        opened[tag] -= 1
        if label is not None:
            path.pop()
        if tag in ("article", "main"):
            main_depth -= 1

    def end_until(tags: set[str], bounds: set[str]) -> None:
        """Close the elements down to the last open one of ``tags``, if no bound is nearer."""
        if not any(opened.get(t) for t in tags):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                while len(stack) > at:
                    pop()
                return
            if stack[at][0] in bounds:
                return

    text, at = page or "", 0
    while token := _TOKEN.match(text, at):
        at = token.end()
        words = token["text"]
        if words is not None:
            if pieces and pieces[-1].block == block and pieces[-1].path == tuple(path):
                pieces[-1] = pieces[-1]._replace(text=pieces[-1].text + words)
            else:
                pieces.append(Piece(tuple(path), block, words))
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag, is_block = tag.lower(), tag.lower() in BLOCK
        if is_block:
            block += 1
        if token["end"] or token["end2"]:
            if is_block:
                end_until({tag}, {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "body", "html") else set())
            else:
                end_until({tag}, set(BLOCK))
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(Piece(tuple(path), block, " "))
            continue
        if is_block and opened.get("p") and tag not in ("option", "optgroup", "legend"):
            end_until({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            while any(opened.get(t) for t in ends):
                before = len(stack)
                end_until(ends, bounds)
                if len(stack) == before:
                    break
        if tag in HEADINGS:
            end_until(set(HEADINGS), set(BLOCK) - HEADINGS)
        attributes = token["attributes"] or token["attributes2"] or ""
        if tag in RAW:
            closing = _RAW_END[tag].search(text, at)
            at = closing.start() if closing else len(text)
        if attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        label = _label(tag, attributes, main_depth > 0)
        inline = not is_block and label == tag
        nested = bool(path) and path[-1][0] == label and tag in ("div", "section", "center")
        shown = None if inline or nested or len(path) >= DEPTH else label
        number += 1
        stack.append((tag, shown, number))
        opened[tag] = opened.get(tag, 0) + 1
        if shown is not None:
            path.append((shown, number))
        if tag in ("article", "main"):
            main_depth += 1
    return [p._replace(text=entities.unescape(p.text)) for p in pieces]


# --- expressions ----------------------------------------------------------------------
#
# A part is [label, how often, texts, parts]: how often is "1", "?", "+" or "*"; a text slot has the
# label "#" and the digests of the texts that all pages have there; a repeated group has the label "()".

Part = list


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def expression_of(pieces: Iterable[Piece]) -> list[Part]:
    """The expression of one page."""
    shown = [(p.path, " ".join(p.text.split())) for p in pieces]
    return _listed(_sequence([(path, text) for path, text in shown if text], 0))


def _listed(parts: list[Part]) -> list[Part]:
    """The parts of one page with their texts, sets while they are gathered, as lists."""
    return [[label, how, sorted(texts), _listed(inner)] for label, how, texts, inner in parts]


def _sequence(pieces: list[tuple], depth: int) -> list[Part]:
    parts = []
    for key, own in groupby(pieces, key=lambda p: p[0][depth] if len(p[0]) > depth else None):
        own = list(own)
        if key is None:
            parts += [["#", "1", {_digest(text)}, []] for _, text in own]
        else:
            parts.append([key[0], "1", set(), _sequence(own, depth + 1)])
    return _once_each(parts)


def _joined(a: str, b: str, again: bool = False) -> str:
    """How often a part occurs that two expressions have, or that comes ``again`` in one."""
    optional = a in "?*" and b in "?*" if again else a in "?*" or b in "?*"
    repeated = again or a in "+*" or b in "+*"
    return ("*" if repeated else "?") if optional else ("+" if repeated else "1")


def _optional(how: str) -> str:
    return "*" if how in "+*" else "?"


def _merged(a: Part, b: Part) -> Part:
    """One part for those of two pages."""
    texts = a[2] if a[2] == b[2] else sorted({*a[2]} & {*b[2]})
    return [a[0], _joined(a[1], b[1]), texts, aligned(a[3], b[3])]


def _instance(a: Part, b: Part, again: bool = False) -> Part:
    """One part for those of two elements of one page, which has the texts of both."""
    if isinstance(a[2], set):
        texts = a[2]
        texts.update(b[2])
    else:
        texts = a[2] if a[2] == b[2] else sorted({*a[2], *b[2]})
    inner = a[3] if a[3] == b[3] else _once_each(_both(a[3], b[3], _instance))
    return [a[0], _joined(a[1], b[1], again), texts, inner]


def _again(a: Part, b: Part) -> Part:
    """One part for two that come after each other."""
    return _instance(a, b, again=True)


def _loose(part: Part) -> Part:
    """A part that another page lacks: optional, and without a text that all have."""
    return [part[0], _optional(part[1]), [], [_bare(p) for p in part[3]]]


def _bare(part: Part) -> Part:
    return [part[0], part[1], [], [_bare(p) for p in part[3]]]


def _labels(part: Part) -> list[str]:
    return [p[0] for p in part[3]] if part[0] == "()" else [part[0]]


def _once_each(parts: list[Part]) -> list[Part]:
    """The sequence with every label once: what comes again is a repetition or part of a repeated group."""
    out: list[Part] = []
    where: dict[str, int] = {}
    for part in parts:
        first = min((where[label] for label in _labels(part) if label in where), default=None)
        if first is None:
            where.update((label, len(out)) for label in _labels(part))
            out.append(part)
        elif first == len(out) - 1 and out[-1][0] == part[0] != "()":
            out[-1] = _again(out[-1], part)
        else:
            inside: dict[str, Part] = {}
            for member in [*out[first:], part]:
                for own in member[3] if member[0] == "()" else [member]:
                    own = [own[0], _optional(own[1]), *own[2:]]
                    known = inside.get(own[0])
                    inside[own[0]] = own if known is None else _again(known, own)
            out[first:] = [["()", "*", [], [*inside.values()]]]
            where.update((label, first) for label in inside)
    return out


def aligned(a: list[Part], b: list[Part]) -> list[Part]:
    """One expression for what either of two, of different pages, stands for."""
    return a if a == b else _once_each(_both(a, b, _merged))


def _members(part: Part) -> list[Part]:
    return part[3] if part[0] == "()" else [part]


def _both(a: list[Part], b: list[Part], merge) -> list[Part]:
    """Two sequences as one: parts that share a label, in the longest such order, are merged.

    Of the others, a label that both have stands at both places, and one that only one has is
    optional.
    """
    keys_a = [frozenset(_labels(p)) for p in a]
    keys_b = [frozenset(_labels(p)) for p in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if keys_a[i] & keys_b[j]:
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + 1)
    own_a, own_b = ({m[0]: m for p in side for m in _members(p)} for side in (a, b))

    def member(label: str) -> Part:
        if label in own_a and label in own_b:
            return merge(own_a[label], own_b[label])
        lone = own_a.get(label) or own_b[label]
        return _loose(lone) if merge is _merged else [lone[0], _optional(lone[1]), *lone[2:]]

    def part_of(*parts: Part) -> Part:
        """One part for those at one place, or for the only one there."""
        labels = list(dict.fromkeys(label for p in parts for label in _labels(p)))
        if all(p[0] != "()" for p in parts):
            return member(labels[0])
        members = [member(label) for label in labels]
        return ["()", "*", [], [[m[0], _optional(m[1]), *m[2:]] for m in members]]

    parts, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if keys_a[i] & keys_b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            parts.append(part_of(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            parts.append(part_of(a[i]))
            i += 1
        else:
            parts.append(part_of(b[j]))
            j += 1
    return parts + [part_of(p) for p in [*a[i:], *b[j:]]]


class Wrapper(NamedTuple):
    """An expression, and the least digests of the pages that it comes from, :data:`SEEN` at most."""

    parts: list[Part]
    seen: list[str]

    def text(self) -> str:
        return json.dumps([self.parts, self.seen], separators=(",", ":"))

    def with_page(self, page: str | None) -> Wrapper:
        pieces = pieces_of(page)
        own = Wrapper(expression_of(pieces), [_digest("\n".join(p.text for p in pieces))])
        return self.with_other(own)

    def with_other(self, other: Wrapper) -> Wrapper:
        seen = sorted({*self.seen, *other.seen})[:SEEN]
        if not self.seen:
            return Wrapper(other.parts, seen)
        return Wrapper(aligned(self.parts, other.parts), seen)


EMPTY = Wrapper([], [])


def wrapper_of(text: str) -> Wrapper:
    return Wrapper(*json.loads(text))


# --- extraction -----------------------------------------------------------------------

FRAME = 9


def _tier(path: tuple[str, ...]) -> int:
    """How near a slot is to the article: 0 in it, 1 in the main part, 2 elsewhere, FRAME in the frame."""
    if any(label.endswith("!") for label in path):
        return FRAME
    for at, label in enumerate(path):
        if label == "header?" and not any(rest in HEADINGS for rest in path[at:]):
            return FRAME
    if "article" in path:
        return 0
    return 1 if any(label.endswith("*") for label in path) else 2


@lru_cache(maxsize=256)
def slots_of(wrapper: str) -> dict[tuple[str, ...], tuple[int, frozenset[str]]]:
    """The tier of every slot of a wrapper, by the labels of the elements around it, and its fixed texts.

    Texts outside the article and the main part that all pages share belong to the frame, if there
    are :data:`SEEN` different pages.
    """
    parts, seen = json.loads(wrapper)
    slots: dict[tuple[str, ...], tuple[int, frozenset[str]]] = {}

    def walk(parts: list[Part], path: tuple[str, ...]) -> None:
        for label, _, texts, inner in parts:
            if label == "()":
                walk(inner, path)
            elif label == "#":
                tier = _tier(path)
                slots[path] = tier, frozenset(texts if tier == 2 and len(seen) >= SEEN else ())
            else:
                walk(inner, (*path, label))

    walk(parts, ())
    return slots


def article_of(page: str | None, wrapper: str) -> str:
    """The texts of the page in the slots that its wrapper has nearest to the article, block by block."""
    slots = slots_of(wrapper)
    blocks: dict[int, dict[int, list[str]]] = {}
    for piece in pieces_of(page):
        path = tuple(label for label, _ in piece.path)
        tier, fixed = slots.get(path) or (_tier(path), ())  # a place of white space only has no slot
        if tier == FRAME or fixed and _digest(" ".join(piece.text.split())) in fixed:
            continue
        blocks.setdefault(tier, {}).setdefault(piece.block, []).append(piece.text)
    for tier in sorted(blocks):
        texts = [" ".join("".join(own).split()) for own in blocks[tier].values()]
        if any(texts):
            return "\n\n".join(t for t in texts if t)
    return ""


def merged_runs(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """One wrapper for each run of equal hosts of (host, wrapper) rows."""
    for host, own in groupby(rows, key=lambda row: row[0]):
        wrapper = EMPTY
        for _, text in own:
            wrapper = wrapper.with_other(wrapper_of(text))
        yield host, wrapper.text()
