"""Main text of web pages by wrappers that are inferred from pages of the same host.

A page is a stream of tags and text. Streams of a host are folded (neighbouring repeats become one repeated group, text
becomes a slot) and aligned one after the other: equal nodes stay, what only one side has becomes an optional group, and a
group that one side repeats is repeated. The result is a union-free expression. Partial wrappers of the tasks are aligned
by host, so every page takes part. A wrapper names the main container: the article element if the host uses one, else the
main element, else the path that holds most varying text outside links.

Every page is then matched against its host's expression, which tells the slot of each of its texts. A slot that holds one
and the same text on ``PROOF`` pages or more of different main text is template and is dropped, wherever it stands. Within the
container, all other blocks count but those in menus, headers and footers of the site, sidebars, notices, adverts, forms,
scripts, styles and reader comments; a class or id of double meaning (``_SOFT``) does not exclude a slot whose text varies,
most of it outside links, on as many pages. Pages that the expression does not accept, and slots seen on fewer pages, go by tags and
words alone; a page whose main text would be template throughout keeps it. Character references are decoded, white space
in a block becomes one space, and blocks are joined by one line feed. ``br`` is white space.

Defined results: null and empty html, and pages without such text, give an empty text; a page of any length is read whole, in
time linear in it (elements nested deeper than ``MAX_DEPTH`` stand beside each other); a cut page counts as far as it
goes; a null url is a host of its own; equal rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, spread

#: Bytes of wrappers up to which every task gets them all; beyond it pages are joined to theirs, hosts salted.
BROADCAST_BYTES = 16_000_000
SALTS = 16
#: Groups in which the partial wrappers of a host meet first.
GROUPS = 64
#: Pages of different main text on which a slot must be seen before it is called template or varying.
PROOF = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
_DROP_TAGS = frozenset("nav footer aside form head button select dialog menu".split()) | _RAW
#: Words in a class, id or role that mark what is not the article.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager share sharing social related recommended comment comments reply replies respond disqus "
    "footer masthead login signup form search toolbar widget skip complementary contentinfo".split())
#: Those that an article's own parts may carry as well.
_SOFT = frozenset("aside alert notice notices related search skip menu navigation social form toolbar widget complementary".split())
#: Words that say nothing of what a part is; a name made of these and of marking words marks a part, one with any other word does not.
_NEUTRAL = frozenset(
    "a all area articles bar block body bottom box button buttons card center col column container content cta element foot footers group head "
    "header headers heading holder icon icons inline inner item items layout left lg link links list main md media module nav outer page pages "
    "panel part post posts primary right row section secondary sm side site slot small sticky text thread title top unit wide wrap wrapper zone "
    "box1 v x".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that nest; what opens deeper stands beside, as in browsers, and keeps its text.
MAX_DEPTH = 512
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``text``, ``open`` with the attributes' text, or ``close``; raw elements give no text."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[/!?A-Za-z][^<>]*\Z", rest)  # a tag that the end of the page cuts
            yield "text", "", rest[:cut.start()] if cut else rest
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", name, ""


def _marks(attributes: str) -> tuple[str, frozenset[str]]:
    """The class as a signature, and the marking words of class, id and role: those of names that hold no other word of meaning."""
    shape, words = "", set()
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class":
            shape = ".".join(value.split()[:2])
        for name in value.split():
            parts = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))]
            marking = [w for w in parts if w in _DROP_WORDS]
            if marking and all(w in _DROP_WORDS or w in _NEUTRAL for w in parts):
                words.update(marking)
    return shape, frozenset(words)


class Page:
    """Blocks of a page: each a path of (tag.class), whether it is dropped (1: by a word of ``_SOFT``, 2: for other reasons), its
    text, and the characters in links."""

    def __init__(self, page: str | None):
        self.blocks: list[tuple[tuple[str, ...], int, str, int]] = []
        self.stream: list[str] = []
        path: list[tuple[str, str, int, bool]] = []  # tag, signature, dropped, in a link
        opened: dict[str, int] = {}  # tags of the path
        deeper: dict[str, int] = {}  # open elements that did not nest
        text, links = [], 0

        def flush() -> None:
            nonlocal text, links
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append((tuple(p[1] for p in path), path[-1][2] if path else 0, joined, links))
                self.stream.append("#")
            text, links = [], 0

        def close(k: int) -> None:
            self.stream.extend(f"</{p[1]}>" for p in reversed(path[k:]) if p[0] in _BLOCK)
            for p in path[k:]:
                opened[p[0]] -= 1
            del path[k:]

        for kind, name, rest in tokens(page or ""):
            if kind == "text":
                got = html.unescape(rest)
                text.append(got)
                if path and path[-1][3]:
                    links += len(got.strip())
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in _BLOCK or name in _RAW:
                flush()
            if kind == "open":
                if name in _VOID:
                    continue
                if name in ("p", "li") and opened.get(name):  # an open one ends where the next begins
                    k = max(i for i, p in enumerate(path) if p[0] == name)
                    if not any(p[0] in ("ul", "ol", "div", "article", "section", "td", "blockquote") for p in path[k + 1:]):
                        close(k)
                if len(path) >= MAX_DEPTH:
                    deeper[name] = deeper.get(name, 0) + 1
                    continue
                shape, words = _marks(rest) if rest else ("", frozenset())
                inside = bool(opened.get("article") or opened.get("main"))
                drop = path[-1][2] if path else 0
                if name in _DROP_TAGS or name == "header" and not inside or "hidden" in rest.split():
                    drop = 2
                elif name not in ("html", "body", "article", "main", "p") and name not in _HEADS and words:
                    drop = max(drop, 2 if words - _SOFT else 1)
                sign = f"{name}.{shape}" if shape else name
                path.append((name, sign, drop, name == "a" or bool(path) and path[-1][3]))
                opened[name] = opened.get(name, 0) + 1
                if name in _BLOCK:
                    self.stream.append(f"<{sign}>")
            elif deeper.get(name):
                deeper[name] -= 1
            elif opened.get(name):
                close(next(i for i in range(len(path) - 1, -1, -1) if path[i][0] == name))
        flush()
        close(0)


def fold(stream: list, longest: int = 32) -> list:
    """Neighbouring equal groups of up to ``longest`` nodes become one repeated group ``["+", [...]]``."""
    nodes = list(stream)
    for size in range(1, longest + 1):
        out: list = []
        k = 0
        while k < len(nodes):
            if k + size >= len(nodes) or nodes[k] != nodes[k + size]:
                out.append(nodes[k])
                k += 1
                continue
            group = nodes[k:k + size]
            n = k + size
            while len(group) == size and nodes[n:n + size] == group:
                n += size
            if n > k + size:
                out.append(group[0] if size == 1 and isinstance(group[0], list) and group[0][0] == "+" else ["+", group])
                k = n
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """One expression for both: equal nodes stay, others become optional groups, a group repeated on a side is repeated."""
    key = lambda x: json.dumps(x[1] if isinstance(x, list) and x[0] in "+?" else [x])
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb and a == b:
        return a
    out: list = []
    for what, i1, i2, j1, j2 in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2]):
                both = [n[0] if isinstance(n, list) else "" for n in (x, y)]
                inner = x[1] if isinstance(x, list) else [x]
                if "+" in both and "?" in both:
                    out.append(["?", [["+", inner]]])
                else:
                    mark = max(both)
                    out.append([mark, inner] if mark else x)
        else:
            for part in (a[i1:i2], b[j1:j2]):
                if part:
                    alone = len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?"
                    out.append(part[0] if alone else ["?", part])  # an optional group among others stays one of its own
    return fold(out)


class Matcher:
    """The expression as an automaton of its positions; tells which position each node of a page's stream takes."""

    def __init__(self, nodes: list):
        self.follow: list[int] = []
        self.of: dict[str, int] = {}
        self._known: dict[tuple, list[int] | None] = {}
        self.first, self.last, self.empty = self._sequence(nodes)

    def _sequence(self, nodes: list) -> tuple[int, int, bool]:
        """Bits of the first and last positions, and whether nothing is accepted too."""
        first, last, empty = 0, 0, True
        for node in nodes:
            if isinstance(node, list):
                f, z, e = self._sequence(node[1])
                if node[0] == "+":
                    self._link(z, f)
                e = e or node[0] == "?"
            else:
                f = z = 1 << len(self.follow)
                e = False
                self.follow.append(0)
                self.of[node] = self.of.get(node, 0) | f
            self._link(last, f)
            first |= f if empty else 0
            last = z | (last if e else 0)
            empty = empty and e
        return first, last, empty

    def _link(self, last: int, first: int) -> None:
        for k in _bits(last):
            self.follow[k] |= first

    def slots(self, stream: list[str]) -> list[int] | None:
        """The position of each text of the stream; None if the expression does not accept it."""
        key = tuple(stream)
        if key not in self._known:
            if len(self._known) > 500:
                self._known.clear()
            self._known[key] = self._match(stream)
        return self._known[key]

    def _match(self, stream: list[str]) -> list[int] | None:
        steps, reach = [], self.first
        for node in stream:
            now = reach & self.of.get(node, 0)
            if not now:
                return None
            steps.append(now)
            reach = 0
            for k in _bits(now):
                reach |= self.follow[k]
        good, out = self.last, []
        for node, now in zip(reversed(stream), reversed(steps)):
            at = next((k for k in _bits(now) if good >> k & 1), None) if not out else next((k for k in _bits(now) if self.follow[k] >> out[-1] & 1), None)
            if at is None:
                return None
            out.append(at)
        return [k for k, node in zip(reversed(out), stream) if node == "#"]


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Wrapper:
    """The expression of a host, and by path: pages, characters, characters in links, the digest of its text or "" if it varies."""

    def __init__(self, nodes: list | None = None, slots: dict[str, list] | None = None):
        self.nodes, self.slots = nodes, slots or {}
        self._seen: set[int] = set()
        self._matcher: Matcher | None = None

    def add(self, page: Page) -> None:
        name = hash(tuple(page.stream))
        if name not in self._seen:  # an equal stream changes nothing, nor does one that the expression accepts
            if len(self._seen) > 2000:
                self._seen.clear()
            self._seen.add(name)
            if self._matcher is None or self._matcher.slots(page.stream) is None:
                nodes = fold(page.stream)
                self.nodes = nodes if self.nodes is None else align(self.nodes, nodes)
                self._matcher = Matcher(self.nodes)
        for path, drop, text, links in page.blocks:
            if not drop:
                self._slot("/".join(path), [1, len(text), links, str(hash_text(text))])

    def _slot(self, path: str, new: list) -> None:
        old = self.slots.get(path)
        self.slots[path] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], old[3] if old[3] == new[3] else ""]

    def merge(self, other: Wrapper) -> None:
        if other.nodes is not None:
            self.nodes = other.nodes if self.nodes is None else align(self.nodes, other.nodes)
        for path, slot in other.slots.items():
            self._slot(path, slot)

    def container(self) -> str:
        """The path of the main container; a bare tag name where it is a tag wherever it stands."""
        for tag in ("article", "main"):
            if any(tag in _tags(path) for path in self.slots):
                return tag
        inside: dict[str, float] = {}
        total = 0.0
        for path, (n, chars, links, same) in self.slots.items():
            worth = max(0, chars - 2 * links) * (0.0 if same and n > 2 else 1.0)
            total += worth
            parts = path.split("/")
            for k in range(1, len(parts)):
                prefix = "/".join(parts[:k])
                inside[prefix] = inside.get(prefix, 0.0) + worth
        good = [p for p, w in inside.items() if total and w >= 0.6 * total]
        return max(good, key=lambda p: (p.count("/"), p), default="")


def _tags(path: str) -> list[str]:
    return [p.split(".", 1)[0] for p in path.split("/")]


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def main_text(page: Page, container: str, slots: list[int] | None = None, template: frozenset[int] = frozenset(), varied: frozenset[int] = frozenset()) -> str:
    """The kept blocks within the container; without it, within the page's article or main element, else all.

    ``slots`` are those of the page's blocks, ``template`` and ``varied`` what the host's pages prove of them.
    """
    at = slots if slots is not None else [-1] * len(page.blocks)
    rows = [(b[0], b[2], k) for b, k in zip(page.blocks, at) if not b[1] or b[1] == 1 and k in varied and any(_inside(b[0], t) for t in ("article", "main", container))]
    tried = ["article", "main"]
    for where in [container, *tried] if container in tried else [*tried, container]:
        some = [(text, k) for path, text, k in rows if _inside(path, where)]
        if some:
            break
    else:
        some = [(text, k) for _, text, k in rows]
    return "\n".join([text for text, k in some if k not in template] or [text for text, _ in some])


def _inside(path: tuple[str, ...], container: str) -> bool:
    if container in ("article", "main"):
        return container in [p.split(".", 1)[0] for p in path]
    return bool(container) and ("/".join(path) + "/").startswith(container + "/")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    found: dict[str, Wrapper] = {}
    salt = TaskContext.get().partitionId() % GROUPS

    def emit() -> pa.RecordBatch:
        rows = [(h, json.dumps(w.nodes), json.dumps(w.slots)) for h, w in found.items()]
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(rows), pa.int32())], names=["host", "nodes", "slots", "salt"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(host, Wrapper()).add(Page(page.as_py()))
        if len(found) > 20_000:
            yield emit()
            found.clear()
    yield emit()


def _merged(last: bool):
    """Partial wrappers sorted by host become one row a host: a partial wrapper again, or at last the host's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, Wrapper()

        def emit() -> pa.RecordBatch:
            row = [host, json.dumps(wrapper.nodes), wrapper.container() if last else json.dumps(wrapper.slots)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in row], names=["host", "wrapper" if last else "nodes", "container" if last else "slots"])

        for batch in batches:
            for name, nodes, slots in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if name != host:
                    if host is not None:
                        yield emit()
                    host, wrapper = name, Wrapper()
                wrapper.merge(Wrapper(json.loads(nodes), json.loads(slots)))
        if host is not None:
            yield emit()

    return run


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (the expression as JSON) and ``container``, inferred from all pages."""
    rows = spread(pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")))
    partial = rows.mapInArrow(_partial, "host string, nodes string, slots string, salt int")
    # A host of very many pages has a partial wrapper a task; they meet in groups first.
    grouped = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "nodes", "slots")
    some = grouped.select("host", "nodes", "slots").mapInArrow(_merged(False), "host string, nodes string, slots string")
    dealt = some.repartition("host").sortWithinPartitions("host", "nodes", "slots")
    return materialize(dealt.mapInArrow(_merged(True), "host string, wrapper string, container string"), "wrappers")


class _Hosts:
    """Matchers by host, a bounded number at a time."""

    def __init__(self):
        self._held: dict[str, Matcher] = {}

    def __call__(self, host: str, wrapper: str | None) -> Matcher:
        if host not in self._held:
            if len(self._held) > 2000:
                self._held.clear()
            self._held[host] = Matcher(json.loads(wrapper or "null") or [])
        return self._held[host]


def _wrapper_columns(batch: pa.RecordBatch, known: dict[str, tuple] | None, names: tuple[str, ...]) -> list[tuple]:
    if known is not None:
        return [known.get(h, (None,) * len(names)) for h in batch.column("host").to_pylist()]
    return list(zip(*(batch.column(n).to_pylist() for n in names)))


def _merge_slots(into: dict[int, list], slot: int, new: list) -> None:
    """A slot's record: the digest of its text or "" if it varies, up to ``PROOF`` main texts, characters, those in links."""
    old = into.get(slot)
    into[slot] = new if old is None else [
        old[0] if old[0] == new[0] else "", sorted({*old[1], *new[1]})[:PROOF], old[2] + new[2], old[3] + new[3]]


def _seen(known: dict[str, tuple] | None):
    """What the slots of each host hold on the pages of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        name = lambda text: xxhash.xxh64_hexdigest(text.encode("utf-8", "replace"))
        found: dict[str, dict[int, list]] = {}
        matcher = _Hosts()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(s) for s in found.values()], pa.string())], names=["host", "slots"])

        for batch in batches:
            for host, page, (wrapper, container) in zip(batch.column("host").to_pylist(), batch.column("html"), _wrapper_columns(batch, known, ("wrapper", "container"))):
                one = Page(page.as_py())
                slots = matcher(host, wrapper).slots(one.stream)
                if slots is None:
                    continue
                into, main = found.setdefault(host, {}), name(main_text(one, container or ""))
                for (_, _, text, links), slot in zip(one.blocks, slots):
                    _merge_slots(into, slot, [name(text), [main], len(text), links])
            if len(found) > 20_000:
                yield emit()
                found.clear()
        yield emit()

    return run


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot records sorted by host become one row a host: its template slots and its varying ones."""
    host, slots = None, {}

    def emit() -> pa.RecordBatch:
        sure = {k: s for k, s in slots.items() if len(s[1]) >= PROOF}
        row = [[host], [json.dumps(sorted(k for k, s in sure.items() if s[0]))], [json.dumps(sorted(k for k, s in sure.items() if not s[0] and 2 * s[3] < s[2]))]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in row], names=["host", "template", "varied"])

    for batch in batches:
        for name, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != host:
                if host is not None:
                    yield emit()
                host, slots = name, {}
            for k, new in json.loads(some).items():
                _merge_slots(slots, int(k), new)
    if host is not None:
        yield emit()


def _extract(known: dict[str, tuple] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Hosts()
        for batch in batches:
            texts = []
            names = ("wrapper", "container", "template", "varied")
            for host, page, (wrapper, container, template, varied) in zip(batch.column("host").to_pylist(), batch.column("html"), _wrapper_columns(batch, known, names)):
                one = Page(page.as_py())
                proved = [frozenset(json.loads(x or "[]")) for x in (template, varied)]
                slots = matcher(host, wrapper).slots(one.stream) if any(proved) else None
                texts.append(main_text(one, container or "", slots, *proved))
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return run


def _beside(rows: DataFrame, inferred: DataFrame) -> tuple[DataFrame, dict[str, tuple] | None]:
    """The pages and the hosts' rows for a task: as a dictionary if they are small, else joined on, hosts salted."""
    names = [c for c in inferred.columns if c != "host"]
    bound = inferred.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names), F.octet_length("host")))).first()[0] or 0
    if bound <= BROADCAST_BYTES:
        return spread(rows), {r.host: tuple(r[c] for c in names) for r in inferred.collect()}
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    each = inferred.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(each, ["host", "salt"], "left").drop("salt"), None


def proofs(rows: DataFrame, inferred: DataFrame) -> DataFrame:
    """``inferred`` with ``template`` and ``varied``: the slots of each host that its pages prove to be so."""
    dealt, known = _beside(rows, inferred)
    seen = dealt.mapInArrow(_seen(known), "host string, slots string").repartition("host").sortWithinPartitions("host")
    return materialize(inferred.join(seen.mapInArrow(_proved, "host string, template string, varied string"), "host", "left"), "proofs")


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: its main text. The pages are read three times and shuffled only if there are very many hosts."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    dealt, known = _beside(rows, proofs(rows, wrappers(pages)))
    return dealt.mapInArrow(_extract(known), "page_id long, url string, text string, n_chars long")
