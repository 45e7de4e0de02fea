"""HTML extraction by wrapper induction over the pages of a host.

A page becomes a DOM tree, in which neighbouring siblings of one tag are one
repeated node. The trees of a host's pages are aligned by simple tree matching
(the largest order-preserving match of nodes of equal tags) and folded into one
template tree; each template node is a slot. What stands in a slot on most pages
alike is template; what varies is content, whatever recurs beside it in the slot.
Copies of a page under several addresses are one page in that.

Every task folds what it reads into distinct page structures, so only those move;
a host's structures are folded in rounds, and no task holds a large host's
pages. While the wrappers of all hosts are small together they are broadcast, and
pages don't move at all; beyond that pages meet their host's wrapper in chunks.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, written

#: Pages of a chunk, about; wrappers of so many bytes together are broadcast; so many structures of a host, about, are folded at a time.
CHUNK, BROADCAST, FOLD = 256, 32_000_000, 1000
#: Elements deeper than this are no nodes that hold others: their texts and elements are those of the one above, till it ends.
DEPTH = 100
#: A value is template if this share of a host's distinct contents, REPEATS of them at least, stand with it in the slot.
SHARE, REPEATS = 0.5, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag closes those of its own group that are open, up to a container.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_WALL = frozenset("html body article section div main aside nav header footer table ul ol dl td th blockquote form".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var".split())
_HIDDEN = frozenset("head title".split())
#: What tells pages apart stands in the first of these or else outside the second.
_MAIN, _BESIDE = frozenset("article main".split()), frozenset("nav header footer aside form".split())

Tree = tuple  # (tag, (children...))


class Page:
    """``tags`` and ``parents`` of all nodes in order, and ``texts`` as (node, text); node 0 is the root."""

    __slots__ = ("tags", "parents", "texts")

    def __init__(self, source: str):
        self.tags, self.parents, self.texts = ["#root"], [-1], []
        tags, parents, texts = self.tags, self.parents, self.texts
        stack, at = [0], 0
        deep: dict[str, int] = {}  # elements that are open but not on the stack
        for m in _TOKEN.finditer(source):
            a = m.start()
            if a > at:
                text = source[at:a]
                if not text.isspace():
                    texts.append((stack[-1], text))
            at = m.end()
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if m.group(2):
                if deep.get(name):
                    deep[name] -= 1
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        deep.clear()
                        break
                    if tags[stack[k]] in _WALL and name not in _WALL:
                        break  # an end tag doesn't reach out of its container
                continue
            closes = _CLOSES.get(name) or ({"p"} if name in _ENDS_P else ())
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    open_ = tags[stack[k]]
                    if open_ in closes and not any(deep.values()):
                        del stack[k:]
                        break
                    if open_ in _WALL:
                        break
            tags.append(name)
            parents.append(stack[-1])
            if name not in _VOID and not m.group(4).endswith("/"):
                if len(stack) < DEPTH:
                    stack.append(len(tags) - 1)
                else:
                    deep[name] = deep.get(name, 0) + 1
        if at < len(source) and not source[at:].isspace():
            texts.append((stack[-1], source[at:]))


def match(a: Tree, b: Tree, memo: dict) -> int:
    """Simple tree matching: how many nodes of ``a`` and ``b`` can be aligned."""
    if a[0] != b[0]:
        return 0
    if not a[1] or not b[1]:
        return 1
    key = (a, b)
    if key not in memo:
        memo[key] = 1 + int(_table(a[1], b[1], memo)[-1, -1])
    return memo[key]


def _table(xs: tuple, ys: tuple, memo: dict) -> np.ndarray:
    out = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
    kinds = {y: i for i, y in enumerate(dict.fromkeys(ys))}
    at, known = np.array([kinds[y] for y in ys], np.int64), {}
    for i, x in enumerate(xs):
        if x not in known:
            known[x] = np.array([match(x, y, memo) for y in kinds], np.int32)[at]
        out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + known[x]))
    return out


def align(xs: tuple, ys: tuple, memo: dict) -> list[tuple[int | None, int | None]]:
    """The steps of the best alignment of two lists of trees, in order: pairs of places, or one of them alone."""
    table, i, j, steps = _table(xs, ys, memo), len(xs), len(ys), []
    while i or j:
        if j and table[i, j] == table[i, j - 1]:
            j -= 1
            steps.append((None, j))
        elif i and table[i, j] == table[i - 1, j]:
            i -= 1
            steps.append((i, None))
        else:
            i, j = i - 1, j - 1
            steps.append((i, j))
    return steps[::-1]


def fold(a: Tree, b: Tree, memo: dict) -> Tree:
    """The tree of all nodes of ``a`` and ``b``, aligned ones once; ``a[0] == b[0]``."""
    if a == b or not b[1]:
        return a
    if not a[1]:
        return b
    children = [a[1][i] if j is None else b[1][j] if i is None else fold(a[1][i], b[1][j], memo) for i, j in align(a[1], b[1], memo)]
    return a[0], _runs(children, memo)[0]


def _runs(children: list[Tree], memo: dict) -> tuple[tuple, list[int]]:
    """Neighbours of one tag folded into one, and where each child went."""
    out, where = [], []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = fold(out[-1], c, memo)
        else:
            out.append(c)
        where.append(len(out) - 1)
    return tuple(out), where


def show(t: Tree) -> str:
    return f"{t[0]}({','.join(map(show, t[1]))})" if t[1] else t[0]


def read(s: str) -> Tree:
    """The tree that ``show`` wrote."""
    stack: list[tuple[str, list]] = [("", [])]
    for m in re.finditer(r"([^(),]+)(\()?|(\))", s):
        if m.group(3):
            tag, children = stack.pop()
            stack[-1][1].append((tag, tuple(children)))
        elif m.group(2):
            stack.append((m.group(1), []))
        else:
            stack[-1][1].append((m.group(1), ()))
    return stack[0][1][0]


def trees_of(tags: tuple, parents: tuple, memo: dict) -> tuple[list[Tree], list[list[int]]]:
    """The tree below each node, repeated siblings folded, and the children of each node."""
    children: list[list[int]] = [[] for _ in tags]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    trees: list[Tree] = [()] * len(tags)
    for i in range(len(tags) - 1, -1, -1):  # parents come before their children
        trees[i] = (tags[i], _runs([trees[c] for c in children[i]], memo)[0] if children[i] else ())
    return trees, children


def structure(page: Page, memo: dict) -> Tree:
    return trees_of(tuple(page.tags), tuple(page.parents), memo)[0][0]


def slots(template: Tree, tags: tuple, parents: tuple, memo: dict) -> list[str]:
    """For each node the slot of ``template`` that it is aligned with; one named by its path if there is none."""
    trees, children = trees_of(tags, parents, memo)
    out = [""] * len(tags)
    todo: list[tuple[list[int], Tree | None, str]] = [([0], template, "0")]  # nodes that share a slot, the template's node, its name
    while todo:
        nodes, node, name = todo.pop()
        for n in nodes:
            out[n] = name
            groups: list[list[int]] = []
            for c in children[n]:
                if groups and tags[groups[-1][0]] == tags[c]:
                    groups[-1].append(c)
                else:
                    groups.append([c])
            if node is None:
                todo += [(g, None, f"{name}>{tags[g[0]]}") for g in groups]
            elif groups:
                for i, j in align(trees[n][1], node[1], memo):
                    if i is not None:
                        todo.append((groups[i], None, f"{name}>{tags[groups[i][0]]}") if j is None else (groups[i], node[1][j], f"{name}.{j}"))
    return out


def merge(trees, memo: dict | None = None) -> Tree:
    """The template of distinct trees, folded in an order that doesn't depend on theirs: the largest first."""
    memo, out = {} if memo is None else memo, ("#root", ())
    for t in sorted(trees, key=lambda t: (-_size(t), show(t))):
        out = fold(out, t, memo)
    return out


def _size(t: Tree) -> int:
    return 1 + sum(map(_size, t[1]))


def values(page: Page, where: list[str]) -> list[tuple[str, int, str]]:
    """The visible texts of a page as (slot, node, text), white space made single."""
    out = []
    for node, text in page.texts:
        if page.tags[node] in _HIDDEN:
            continue
        clean = " ".join(entities.unescape(text).split())
        if clean:
            out.append((where[node], node, clean))
    return out


def gist(page: Page, found: list[tuple[str, int, str]]) -> int:
    """A hash of a page's own texts; copies under several addresses share it, whatever stands in the frame around them."""
    main, beside = [False] * len(page.tags), [False] * len(page.tags)
    for i, (tag, p) in enumerate(zip(page.tags, page.parents)):  # parents come before their children
        main[i] = tag in _MAIN or p >= 0 and main[p]
        beside[i] = tag in _BESIDE or p >= 0 and beside[p]
    own = [t for _, n, t in found if main[n]] or [t for _, n, t in found if not beside[n]] or [t for _, _, t in found]
    return _hash("\n".join(own))


def _block(page: Page, node: int) -> int:
    while page.tags[node] in _INLINE and page.parents[node] > 0:
        node = page.parents[node]
    return node


def content(page: Page, kept: list[tuple[int, str]]) -> str:
    """Texts of one block joined by spaces, blocks by line ends."""
    lines, last = [], None
    for node, text in kept:
        block = _block(page, node)
        if lines and block == last:
            lines[-1] += " " + text
        else:
            lines.append(text)
        last = block
    return "\n".join(lines)


@lru_cache(maxsize=1)
def _matches() -> dict:
    return {}


def _memo() -> dict:
    """Matches that this worker has computed, forgotten when they are too many."""
    memo = _matches()
    if len(memo) > 200_000:
        memo.clear()
    return memo


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, show(t), n) for (host, t), n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "tree", "pages"])

    for batch in batches:
        for host, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            key = host, structure(Page(h or ""), _memo())
            counts[key] = counts.get(key, 0) + 1
            if len(counts) > 50_000:
                yield out()
    yield out()


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tree = merge({read(t) for t in table.column("tree").to_pylist()}, _memo())
    return pa.table({"host": [key[0].as_py()], "tree": [show(tree)], "pages": [sum(table.column("pages").to_pylist())]})


class Wrapper:
    """A host's template and the values of slots that are template."""

    def __init__(self, tree: str, constant=()):
        self.template, self.constant, self.known = read(tree), frozenset((x["slot"], x["value"]) for x in constant or ()), {}

    def values(self, page: Page) -> list[tuple[str, int, str]]:
        """The page's texts by slot; pages of one structure are aligned once."""
        key = tuple(page.tags), tuple(page.parents)
        if key not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[key] = slots(self.template, *key, _memo())
        return values(page, self.known[key])

    def split(self, page: Page) -> tuple[list[tuple[int, str]], int]:
        """The content, and how many texts are template."""
        found = self.values(page)
        kept = [(n, t) for s, n, t in found if (s, _hash(t)) not in self.constant]
        return kept, len(found) - len(kept)


def _counted(wrapper, hosts: list[str], pages: list[str | None]) -> dict[str, pa.Array]:
    """Which values stand with which contents; slot "" has a host's contents themselves."""
    seen: dict[tuple[str, str, int, int], None] = {}
    for host, h in zip(hosts, pages):
        page = Page(h or "")
        if found := wrapper(host).values(page):
            own = gist(page, found)
            seen |= dict.fromkeys([(host, "", 0, own), *((host, s, _hash(t), own) for s, _, t in found)])
    kinds = {"host": pa.string(), "slot": pa.string(), "value": pa.int64(), "gist": pa.int64()}
    return {c: pa.array([k[i] for k in seen], kind) for i, (c, kind) in enumerate(kinds.items())}


def _extracted(wrapper, ids: pa.Array, hosts: list[str], pages: list[str | None]) -> dict[str, pa.Array]:
    texts, content_parts, template_parts = [], [], []
    for host, h in zip(hosts, pages):
        page = Page(h or "")
        kept, rest = wrapper(host).split(page)
        texts.append(None if h is None else content(page, kept)), content_parts.append(len(kept)), template_parts.append(rest)
    return {"page_id": ids, "host": pa.array(hosts, pa.string()), "text": pa.array(texts, pa.string()), "content_parts": pa.array(content_parts, pa.int64()), "template_parts": pa.array(template_parts, pa.int64())}


_COUNTS = "host string, slot string, value long, gist long"


def _mapped(rows: DataFrame, wrappers: DataFrame, counting: bool, schema: str) -> DataFrame:
    """Pages against broadcast wrappers."""
    shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r for r in wrappers.toLocalIterator()})  # of BROADCAST bytes at most, as the caller checks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}

        def wrapper(host: str) -> Wrapper:
            if host not in known:
                r = shared.value[host]
                known[host] = Wrapper(r["tree"], r["constant"])
            return known[host]

        for batch in batches:
            hosts, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_pydict(_counted(wrapper, hosts, pages) if counting else _extracted(wrapper, batch.column(0), hosts, pages))

    return rows.mapInArrow(run, schema)


def _met(rows: DataFrame, wrappers: DataFrame, counting: bool, schema: str, chunk: int) -> DataFrame:
    """Pages against their host's wrapper, a chunk of a host at a time."""
    chunks = F.ceil(F.col("pages") / chunk)
    sizes = wrappers.select("host", chunks.alias("chunks"))
    dealt = rows.join(sizes, "host").select("page_id", "host", "html", F.pmod(F.xxhash64("page_id", "html"), F.col("chunks")).alias("chunk"))
    each = wrappers.select("host", "tree", "constant", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))

    def run(key: tuple[pa.Scalar, ...], pages: pa.Table, found: pa.Table) -> pa.Table:
        own = Wrapper(*(found.column(c)[0].as_py() for c in ("tree", "constant"))) if found.num_rows and pages.num_rows else None
        hosts, html = pages.column("host").to_pylist(), pages.column("html").to_pylist()
        return pa.table(_counted(lambda _: own, hosts, html) if counting else _extracted(lambda _: own, pages.column("page_id"), hosts, html))

    return dealt.groupBy("host", "chunk").cogroup(each.groupBy("host", "chunk")).applyInArrow(run, schema)


def _host() -> Column:
    """The URL's host in lower case, without user, port and a leading "www."; "" if there is none."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.|\.+$", "")


def templates(rows: DataFrame, fold: int = FOLD) -> DataFrame:
    """``(page_id, host, html)`` -> ``(host, tree, pages)``, a row for each host. A host's structures are folded in as many rounds as they need, about ``fold`` at a time."""
    schema = "host string, tree string, pages long"
    trees = written(rows.mapInArrow(_structures, schema).groupBy("host", "tree").agg(F.sum("pages").alias("pages")))
    while True:
        sizes = trees.groupBy("host").agg(F.ceil(F.count("*") / fold).alias("parts"))
        most = sizes.agg(F.max("parts")).first()[0] or 0
        parts = trees.join(sizes, "host").select("host", "tree", "pages", F.pmod(F.xxhash64("tree"), F.col("parts")).alias("part"))
        trees = written(parts.groupBy("host", "part").applyInArrow(_merge, schema))
        if most <= 1:
            return trees


def extract(pages: DataFrame, share: float = SHARE, repeats: int = REPEATS, chunk: int = CHUNK, broadcast: int = BROADCAST) -> DataFrame:
    """``pages`` -> ``(page_id, host, text, content_parts, template_parts)`` for each row.

    ``text`` is the page's content, a line for each block; the parts count texts that
    are content and template. Script, style, comments and the head are neither. On a host of one
    page nothing recurs, so all its text is content. A null page gives null, an empty one an
    empty text. Pages whose URL has no host are those of a host "". Pages of one content, such as repeated
    rows, count once: what only they share doesn't recur. The result doesn't depend on ``chunk`` and ``broadcast``.
    Very long pages are read whole, of very deep ones all text (what is deeper than DEPTH as part of the element there); an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = pick(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.select("page_id", _host().alias("host"), "html")
    found = templates(rows)

    def met(wrappers: DataFrame, counting: bool, schema: str) -> DataFrame:
        size = wrappers.agg(F.sum(200 + F.length("tree") + 100 * F.greatest(F.coalesce(F.size("constant"), F.lit(0)), F.lit(0)))).first()[0] or 0
        return _mapped(rows, wrappers, counting, schema) if size <= broadcast else _met(rows, wrappers, counting, schema, chunk)

    none = F.lit(None).cast("array<struct<slot: string, value: long>>").alias("constant")
    counts = met(found.select("*", none), True, _COUNTS).distinct().groupBy("host", "slot", "value").agg(F.count("*").alias("n"))
    counts = written(counts.filter((F.col("slot") == "") | (F.col("n") >= repeats)))
    contents = counts.filter("slot = ''").select("host", F.col("n").alias("contents"))
    often = counts.filter("slot != ''").join(contents, "host").filter(F.col("n") >= F.greatest(F.lit(float(repeats)), F.col("contents") * share))
    wrapper = often.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("constant"))
    wrappers = written(found.join(wrapper, "host", "left").select("host", "tree", "pages", "constant"))
    return met(wrappers, False, f"page_id {kind}, host string, text string, content_parts long, template_parts long")
