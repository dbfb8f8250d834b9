"""HTML extraction by wrappers: union-free patterns inferred by aligning the token streams of one host's pages.

A page becomes a tree of elements. Two trees are aligned child by child: neighbours that repeat fold into a repeated
group, elements that only one side has become optional, texts become slots. Every task folds its pages into one pattern
a host, and these patterns are folded again, so a hot host costs one small row a task. The pattern tells which element
carries the article; the text of that element is then taken from each page.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.llm.repeats import output
from hazardline.session import stage_table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[A-Za-z/!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu"} | _RAW
_ASIDE_NAMES = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu nav navbar navigation newsletter notice notices popup promo promoted "
    "related reply replies search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Parts of a class name that tells what the page around it has, not what the element is.
_STATES = {"no", "not", "has", "have", "with", "without"}
#: Text of its own, whatever words its id has; and a notice among paragraphs is text as well.
_TEXTUAL = _INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption", "blockquote", "pre"}
#: Elements that a new one of the same group ends.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements may be nested to any depth: functions here call themselves from Python code only, which takes heap, not C stack.
_NESTING = 1 << 30


class Element:
    """``hint`` has the words by which an element stands aside, unless its tag alone says so."""

    __slots__ = ("kids", "name", "aside", "hint")

    def __init__(self, name: str, aside: bool, hint: str = "") -> None:
        self.name, self.aside, self.hint, self.kids = name, aside, hint, []

    def label(self) -> str:
        return f"{self.name} {self.hint}" if self.aside and self.hint else self.name + ("-" if self.aside else "")


def marginal_words(tag: str, attributes: str) -> set[str]:
    """The words of class, id and role that mark a part aside: a whole name, or the first or last part of a class."""
    found = set()
    for kind, *values in _NAMES.findall(attributes):
        for name in "".join(values).lower().split():
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            if not parts or _STATES & set(parts):
                continue
            if kind.lower() == "class":
                found |= {parts[0], parts[-1]} & _ASIDE_NAMES
            elif len(parts) == 1 and not (kind.lower() == "id" and tag in _TEXTUAL):
                found |= set(parts) & _ASIDE_NAMES
    return found - {"notice", "notices"} if tag in _TEXTUAL else found


def parse(page: str | None) -> Element:
    """The elements and texts of a page; unclosed elements end with their parents, a cut-off tag is dropped."""
    root = Element("page", False)
    stack, done, text = [root], 0, page or ""
    while done < len(text):
        m = _TOKEN.search(text, done)
        if (m.start() if m else len(text)) > done:
            stack[-1].kids.append(text[done : m.start() if m else len(text)])
        if not m:
            break
        done = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == tag:
                    del stack[k:]
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(text, done)
            done = end.end() if end else len(text)
            continue
        if tag in _VOID:
            stack[-1].kids.append(Element(tag, False))
            continue
        if tag == "p" or tag not in _INLINE:
            _end(stack, ("p",), ("article", "div", "section", "td", "li", "main", "body"))
        if tag in _ENDS:
            _end(stack, _ENDS[tag], ("ul", "ol", "dl", "table", "select"))
        if tag == "form" or tag in _ASIDE or tag in ("html", "body", "article", "main") or not m[3]:
            element = Element(tag, tag in _ASIDE, "form" if tag == "form" else "")
        else:
            hint = "+".join(sorted(marginal_words(tag, m[3])))
            element = Element(tag, bool(hint), hint)
        stack[-1].kids.append(element)
        stack.append(element)
    return root


def _end(stack: list[Element], names: tuple[str, ...], inside: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in names:
            del stack[k:]
            return
        if stack[k].name in inside:
            return


def blocks(element: Element) -> list[str]:
    """The texts of an element, one for each run of text between block elements, without what stands aside."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    def walk(at: Element) -> None:
        for kid in at.kids:
            if isinstance(kid, str):
                parts.append(kid)
            elif kid.name == "br":
                parts.append(" ")
            elif kid.aside:
                close()
            elif kid.name in _INLINE or kid.name in ("img", "wbr", "input"):
                walk(kid)
            else:
                close()
                walk(kid)
                close()

    walk(element)
    close()
    return out


# A pattern node is [label, quantifier, characters of text aside from marginal parts, children]; '#' is a text slot.


def pattern(element: Element) -> list:
    kids, size = [], 0
    for kid in element.kids:
        if isinstance(kid, str):
            if kid.strip():
                size += len(kid)
                if not kids or kids[-1][0] != "#":
                    kids.append(["#", "1", 0, []])
                kids[-1][2] += len(kid)
        else:
            node = pattern(kid)
            size += node[2]
            kids.append(node)
    return [element.label(), "1", 0 if element.aside else size, fold(kids)]


def _both(a: list, b: list, repeated: bool = False) -> list:
    many = repeated or "+" in (a[1], b[1]) or "*" in (a[1], b[1])
    maybe = "?" in (a[1], b[1]) or "*" in (a[1], b[1])
    return [a[0], "*" if many and maybe else "+" if many else "?" if maybe else "1", a[2] + b[2], align(a[3], b[3])]


def fold(kids: list) -> list:
    """Groups of up to three neighbours that repeat become one repeated group."""
    for period in (1, 2, 3):
        out: list = []
        for kid in kids:
            out.append(kid)
            while len(out) >= 2 * period and [x[0] for x in out[-period:]] == [x[0] for x in out[-2 * period : -period]]:
                again = out[-period:]
                del out[-period:]
                out[-period:] = [_both(a, b, True) for a, b in zip(out[-period:], again, strict=True)]
        kids = out
    return kids


def _optional(node: list) -> list:
    return [node[0], {"1": "?", "+": "*"}.get(node[1], node[1]), node[2], node[3]]


def align(a: list, b: list) -> list:
    """One pattern for two lists of children: equal labels meet in order, the others become optional."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [_both(x, y) for x, y in zip(a, b, strict=True)]
    out: list = []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_both(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [_optional(x) for x in a[i:j] + b[k:m]]
    return fold(out)


def released(root: list) -> list[list[str]]:
    """Paths of elements whose words say aside but which carry the article, outermost first.

    They hold ``main``; or no ``article`` or ``main`` stands outside marginal parts, and they hold an ``article`` or more
    than half of the text. So comments and related articles beside an article stay aside.
    """

    def holds(at: list, names: tuple[str, ...], through: bool = True) -> bool:
        todo = [at]
        while todo:
            node = todo.pop()
            if node[0] in names:
                return True
            if not node[0].endswith("-") and (through or " " not in node[0]):
                todo += node[3]
        return False

    outside, half, out = holds(root, ("article", "main"), False), _gross(root) / 2, []
    path: list[str] = []

    def walk(at: list) -> None:
        for kid in at[3]:
            if kid[0].endswith("-"):
                continue
            path.append(kid[0])
            free = " " not in kid[0] or holds(kid, ("main",)) or not outside and (holds(kid, ("article",)) or _gross(kid) > half)
            if free:
                if " " in kid[0]:
                    out.append(path.copy())
                walk(kid)
            path.pop()

    walk(root)
    return out


def weighed(node: list, free: list[list[str]]) -> list:
    """The pattern with released elements as ordinary ones, and text counted anew; ``free`` has the paths from here on."""
    if node[0] == "#":
        return node
    kids = [weighed(x, [path[1:] for path in free if path and path[0] == x[0]]) for x in node[3]]
    label = node[0].split(" ")[0] if [] in free else node[0]
    return [label, node[1], 0 if label.endswith("-") or " " in label else sum(x[2] for x in kids), kids]


def release(page: Element, free: list[list[str]]) -> None:
    """Elements of a page at the released paths stand aside no more."""
    hit = []
    for path in free:
        found = [page]
        for label in path:
            found = [kid for at in found for kid in at.kids if not isinstance(kid, str) and kid.label() == label]
        hit += found
    for element in hit:
        element.aside = False


def opened(page: Element, free: list[list[str]]) -> Element:
    """The page with its host's released parts; with its own as well, if less than a tenth of its text is left else."""
    release(page, free)
    node = pattern(page)
    if len(blocks(page)) and node[2] * 10 >= _gross(node):
        return page
    release(page, released(node))
    if not blocks(page):
        _open_all(page)
    return page


def _gross(at: list) -> int:
    size, todo = 0, [at]
    while todo:
        node = todo.pop()
        if node[0] == "#":
            size += node[2]
        elif not node[0].endswith("-"):
            todo += node[3]
    return size


def _open_all(at: Element) -> None:
    for kid in at.kids:
        if not isinstance(kid, str):
            kid.aside = kid.aside and not kid.hint
            _open_all(kid)


def main_path(node: list) -> list[str]:
    """Labels from the page down to the element that carries the article: the first of ``main_paths``."""
    ways = main_paths(node)
    return (ways["article"] or ways["main"] or [ways["rest"]])[0]


def main_paths(node: list) -> dict[str, list]:
    """Where the host's pages have their article: all paths of outermost ``article`` and of ``main`` outside marginal
    parts, most text first, and the path to the smallest element that holds all other text (links alone do not count)."""

    path: list[str] = []
    sizes: dict[int, int] = {}

    def named(at: list, name: str, found: list) -> list:
        for kid in at[3]:
            path.append(kid[0])
            if kid[0] == name:
                found.append((-kid[2], path.copy()))
            elif not (kid[0].endswith("-") or " " in kid[0]):
                named(kid, name, found)
            path.pop()
        return found

    def plain(at: list) -> int:
        return sizes[id(at)]

    def weigh(at: list) -> int:
        size = at[2] if at[0] == "#" else 0
        for kid in at[3]:
            size += weigh(kid)
        sizes[id(at)] = 0 if at[0] == "a" or at[0].endswith("-") or " " in at[0] else size
        return sizes[id(at)]

    weigh(node)

    ways: dict[str, list] = {name: [] for name in ("article", "main")}
    for name, paths in ways.items():
        for _, way in sorted(named(node, name, [])):
            if way not in paths:
                paths.append(way)
    rest, at, whole = [], node, plain(node)
    while whole and at[3]:
        best = max(at[3], key=plain)
        if best[0] == "#" or best[1] in "+*" or plain(best) < whole or best[0] in _INLINE:
            break
        rest.append(best[0])
        at = best
    return {**ways, "rest": rest}


def _at(page: Element, path: list[str]) -> list[Element]:
    found = [page]
    for label in path:
        found = [kid for at in found for kid in at.kids if not isinstance(kid, str) and not kid.aside and kid.name == label]
    return found


def _chars(element: Element, links: bool = False) -> int:
    """Characters of text outside marginal parts, without those of links unless ``links``."""
    size, todo = 0, [element]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str):
                size += len("".join(kid.split()))
            elif not kid.aside and (links or kid.name != "a"):
                todo.append(kid)
    return size


def main_text(page: Element, ways: dict[str, list]) -> str:
    """The article's blocks, and the first-level headings before it.

    It is the one ``article`` of the page, or its ``main``, if that has at least half of the page's text, else what holds
    all the page's text. With several articles no choice is made among them: ``main`` has to hold them all.
    """
    whole = _chars(page, True)
    articles = [x for path in ways["article"] for x in _at(page, path)]
    mains = [x for path in ways["main"] for x in _at(page, path)]
    inside = [x for at in mains for x in articles_in(at)]
    for found, fit in ((articles, len(articles) == 1), (mains, all(x in inside for x in articles))):
        if found and fit and 2 * sum(_chars(x, True) for x in found) >= whole:
            return "\n\n".join([b for at in [*_titles(page, found), *found] for b in blocks(at)])
    rest = _at(page, ways["rest"])
    every = sum(_chars(x) for x in rest) == _chars(page) and any(map(_chars, rest))
    return "\n\n".join(b for at in (rest if every else [page]) for b in blocks(at))


def articles_in(at: Element) -> list[Element]:
    out = []
    for kid in at.kids:
        if not isinstance(kid, str) and not kid.aside:
            out += [kid] if kid.name == "article" else articles_in(kid)
    return out


def _titles(page: Element, found: list[Element]) -> list[Element]:
    """The ``h1`` of a page before its article and outside marginal parts."""
    out: list[Element] = []

    def walk(at: Element) -> bool:
        for kid in at.kids:
            if isinstance(kid, str) or kid.aside:
                continue
            if kid in found:
                return True
            if kid.name == "h1":
                out.append(kid)
            elif walk(kid):
                return True
        return False

    walk(page)
    return out


def packed(node: list) -> str:
    """A pattern as one flat list, parents before children: label, quantifier, characters, number of children."""
    flat, todo = [], [node]
    while todo:
        at = todo.pop()
        flat += [*at[:3], len(at[3])]
        todo += reversed(at[3])
    return json.dumps(flat)


def unpacked(text: str) -> list:
    flat, top = json.loads(text), []
    waiting = [[top, 1]]  # lists of children, and how many are still to come
    for i in range(0, len(flat), 4):
        while not waiting[-1][1]:
            waiting.pop()
        waiting[-1][1] -= 1
        kids: list = []
        waiting[-1][0].append([*flat[i : i + 3], kids])
        waiting.append([kids, flat[i + 3]])
    return top[0]


def _fold_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(_NESTING)
    known: dict[str, list] = {}
    for frame in batches:
        for host, page in zip(frame["host"], frame["html"], strict=True):
            new = pattern(parse(page))
            known[host] = _both(known[host], new) if host in known else new
    yield pd.DataFrame({"host": list(known), "wrapper": [packed(x) for x in known.values()]}, dtype=object)


def _fold_rows(table: pa.Table) -> pa.Table:
    sys.setrecursionlimit(_NESTING)
    known = None
    for text in sorted(table.column("wrapper").to_pylist()):
        known = unpacked(text) if known is None else _both(known, unpacked(text))
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [packed(known)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, path): one pattern per host from all its pages (host, html), released parts and the way to the article."""
    partial = pages.mapInPandas(_fold_pages, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    first = partial.groupBy("host", "salt").applyInArrow(lambda _, t: _fold_rows(t), "host string, wrapper string")
    every = stage_table(first.groupBy("host").applyInArrow(lambda _, t: _fold_rows(t), "host string, wrapper string"), "wrappers")

    def paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(_NESTING)
        for frame in frames:
            found = []
            for text in frame["wrapper"]:
                node = unpacked(text)
                free = released(node)
                found.append(json.dumps([free, main_paths(weighed(node, free))]))
            yield frame.assign(path=found)

    return stage_table(every.mapInPandas(paths, "host string, wrapper string, path string"), "paths")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): (page_id, url, text, n_chars).

    Pages of one host (the part after ``://``; without it, the empty host) share a wrapper. ``text`` has the blocks of
    the article with references decoded and white space made one space, joined by an empty line, without menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments; ``n_chars`` counts code points.
    A null or empty page gives the empty text; ids and rows may repeat; other columns are ignored. Elements may be nested
    to any depth.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    paths = infer_wrappers(pages.select("host", "html")).select("host", "path")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(_NESTING)
        for frame in frames:
            texts = []
            for page, way in zip(frame["html"], frame["path"], strict=True):
                free, ways = json.loads(way)
                texts.append(main_text(opened(parse(page), free), ways))
            yield pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    schema = output(pages, "url string, text string, n_chars long", "page_id")
    return pages.join(paths, "host").select("page_id", "url", "html", "path").mapInPandas(cut, schema)
