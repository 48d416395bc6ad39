"""Main text of web pages by removal of site templates.

Each page is parsed into a tree, and each element that can carry boilerplate
gets a hash of its whole subtree.  Hashes are counted by host; subtrees that
recur on LEAST_PAGES different pages of a host are its template and are deleted,
however large the host is.  Pages count as different by a sketch of their text
around the subtree, so near copies of a page count as one and copying deletes
nothing.  What recurs outside articles is deleted outside articles only, what
recurs in different articles inside them only.  Inside articles paragraphs,
headings, items and cells are not deleted on their own, and a page's only article
never is.  Elements whose tag, role or class says that they are no part of an
article go too; of the articles, those with text left count.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter
from hashlib import blake2b
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, materialize, slices

#: A subtree on this many different pages of a host is template; inside articles
#: the different ones must also be this share of those that hold it.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: Smallest hashes of word triples that make up a sketch.
SKETCH = 4
#: Template subtrees up to this count are broadcast, 9 bytes and a host name each.
BROADCAST_TEMPLATES = 500_000

# Element names of the HTML standard by their role here.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Inside articles these mean something only within their whole.
_PARTS = set("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead tfoot caption figcaption legend summary".split())
_NO_ARTICLE = set("head script style textarea title noscript iframe noembed noframes template nav footer aside form button select option datalist input svg canvas audio video object map menu dialog search".split())
_NO_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
_NO_CLASS = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe signup popup modal overlay pagination pager widget toolbar masthead skip".split()
)
#: Words that say where or how large, but not what: "site-footer" is a footer, "share-price" no sharing.
_PLAIN_CLASS = set("site page main top bottom left right list box bar block section wrapper wrap container inner outer item items link links content area slot form posts post articles global primary secondary mobile desktop sticky fixed header body row col column inline small large".split())
_ENDS_P = _BLOCK - set("li dd dt td th tr tbody thead tfoot caption option optgroup body html head legend summary".split())
_SELF_ENDING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = set("ul ol dl table article body section div td th".split())

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|/?[A-Za-z][^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_WHITE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "hints", "parts", "parent", "holds_article", "key", "chars")

    def __init__(self, name: str, hints: frozenset, parent: Element | None):
        self.name, self.hints, self.parent = name, hints, parent
        self.parts: list[Element | str] = []
        self.holds_article, self.key, self.chars = False, b"", 0


def _hints(attributes: str) -> frozenset:
    """What an element's own attributes say: ``hidden``, its roles, and each word
    of its class or id whose other words are no more than a place or a size.

    Only attributes of exactly these names count, not their names within values
    or within longer names; of a repeated one the first counts.
    """
    found, known = set(), set()
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in known:
            continue
        known.add(kind)
        if kind == "role":
            found |= {"role:" + w for w in value.split()}
        elif kind == "hidden":
            found.add("hidden")
        elif kind in ("class", "id"):
            for token in value.split():
                words = set(_WORD.findall(token))
                if words - _PLAIN_CLASS <= _NO_CLASS:
                    found |= words
    return frozenset(found)


def parse(page: str) -> Element:
    """The page's tree.  Any input gives a tree: unmatched end tags are
    ignored, open elements end with their parents, a cut tag is dropped."""
    root = at = Element("#root", frozenset(), None)
    position, size = 0, len(page)
    while position < size:
        m = _TAG.search(page, position)
        if not m:
            at.parts.append(page[position:])
            break
        if m.start() > position:
            at.parts.append(page[position : m.start()])
        position = m.end()
        if not m[2]:
            continue
        if page[position - 1] != ">":  # cut off within a tag
            break
        name = m[2].lower()
        if m[1]:
            up = at
            while up.parent and up.name != name:
                up = up.parent
            if up.parent:
                at = up.parent
            continue
        if name in _ENDS_P:
            up = at
            while up.parent and up.name != "p" and up.name not in _SCOPE:
                up = up.parent
            if up.name == "p":
                at = up.parent
        if name in _SELF_ENDING:
            up = at
            while up.parent and up.name not in _SELF_ENDING[name] and up.name not in ("ul", "ol", "dl", "table", "select", "article"):
                up = up.parent
            if up.name in _SELF_ENDING[name]:
                if name == "tr":
                    while up.parent and up.name != "tr" and up.parent.name not in ("table", "tbody", "thead", "tfoot"):
                        up = up.parent
                at = up.parent
        element = Element(name, _hints(m[3]) if m[3] else frozenset(), at)
        at.parts.append(element)
        if _opens_article(element):
            up = at
            while up and not up.holds_article:
                up.holds_article, up = True, up.parent
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)|</{re.escape(name)}[\s/][^>]*(?:>|\Z)", re.I).search(page, position)
            element.parts.append(page[position : end.start() if end else size])
            position = end.end() if end else size
        elif name not in _VOID and not (m[3] and m[3].endswith("/") and name in ("path", "circle", "rect", "use", "g")):
            at = element
    return root


def _order(root: Element) -> list[Element]:
    """All elements, parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack += [p for p in reversed(e.parts) if not isinstance(p, str)]
    return out


def hash_subtrees(root: Element) -> list[Element]:
    elements = _order(root)
    for e in reversed(elements):
        h = blake2b(e.name.encode(), digest_size=8)
        for p in e.parts:
            if isinstance(p, str):
                shown = _WHITE.sub(" ", p).strip()
                if shown:
                    h.update(b"t" + shown.encode("utf-8", "surrogatepass"))
                    e.chars += len(shown)
            else:
                h.update(b"e" + p.key)
                e.chars += p.chars
        e.key = h.digest()
    return elements


def _opens_article(e: Element) -> bool:
    return e.name in ("article", "main") or "role:main" in e.hints or "role:article" in e.hints


def _candidate(e: Element, inside: bool) -> bool:
    """Whether an element may be deleted as template."""
    return bool(e.chars) and e.parent is not None and e.name in _BLOCK and not e.holds_article and e.name not in ("html", "head", "body", "main") and not (inside and e.name in _PARTS)


def _text_spans(root: Element) -> tuple[list[int], dict[Element, tuple[int, int]]]:
    """Hashes of all word triples of the tree's text in document order, and each
    element's [first, end) among the words."""
    words: list[bytes] = []
    spans: dict[Element, tuple[int, int]] = {}
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            words += _WHITE.sub(" ", item).encode("utf-8", "surrogatepass").split()
        elif isinstance(item, tuple):
            spans[item[0]] = (item[1], len(words))
        else:
            stack.append((item, len(words)))
            stack += reversed(item.parts)
    return [crc32(b" ".join(words[i : i + 3])) for i in range(len(words))], spans


def _running_least(hashes: list[int]) -> list[tuple[int, ...]]:
    """For each k the SKETCH smallest different ones of the first k hashes."""
    out: list[tuple[int, ...]] = [()]
    for h in hashes:
        least = out[-1]
        if len(least) < SKETCH or h < least[-1]:
            least = tuple(sorted({*least, h})[:SKETCH])
        out.append(least)
    return out


class Around:
    """Sketches of the text of a region, the words [low, high), without one of its subtrees."""

    def __init__(self, hashes: list[int], low: int, high: int):
        self.low, self.high = low, high
        self.before, self.after = _running_least(hashes[low:high]), _running_least(hashes[low:high][::-1])

    def of(self, span: tuple[int, int]) -> int:
        least = sorted({*self.before[span[0] - self.low], *self.after[self.high - span[1]]})[:SKETCH]
        return int.from_bytes(blake2b(repr(least).encode(), digest_size=8).digest(), "little", signed=True)


def _regions(root: Element) -> list[Element]:
    """The outermost articles and main elements."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.name in ("article", "main"):
            out.append(e)
        else:
            stack += [p for p in e.parts if not isinstance(p, str)]
    return out


def _deletable(root: Element, regions: list[Element]):
    """(element, inside, region) of all candidates of a hashed tree; a region of
    its own is one (inside) where it stands beside others."""
    stack: list[tuple[Element, Element | None]] = [(root, None)]
    while stack:
        e, region = stack.pop()
        for p in e.parts:
            if isinstance(p, str):
                continue
            if region is None and p.name in ("article", "main"):
                if len(regions) > 1 and _candidate(p, False):
                    yield p, True, None
                stack.append((p, p))
            else:
                if _candidate(p, region is not None):
                    yield p, region is not None, region
                stack.append((p, region))


def subtrees(root: Element) -> set[tuple[bytes, bool, int]]:
    """(key, inside, rest): each candidate of a hashed tree, and a sketch of what
    stands around it: the page's text for candidates outside articles and for
    articles beside others, the article's for those inside it."""
    regions = _regions(root)
    hashes, spans = _text_spans(root)
    page, own = Around(hashes, 0, len(hashes)), {r: Around(hashes, *spans[r]) for r in regions}
    return {(e.key, inside, (page if r is None else own[r]).of(spans[e])) for e, inside, r in _deletable(root, regions)}


def delete_subtrees(root: Element, template: frozenset | set) -> None:
    """Takes the template's subtrees (key, inside) out of a hashed tree, with the
    articles that hold nothing else; if that leaves no article, nothing of the
    articles is deleted."""
    regions = _regions(root)
    gone: dict[Element, bool] = {e: inside for e, inside, _ in _deletable(root, regions) if (e.key, inside) in template}
    if not gone:
        return

    def left(e: Element) -> int:  # what stays of a region
        if e in gone:
            return 0
        chars, stack = e.chars, [e]
        while stack:
            for p in stack.pop().parts:
                if not isinstance(p, str):
                    if p in gone:
                        chars -= p.chars
                    else:
                        stack.append(p)
        return chars

    kept = [r for r in regions if left(r)]
    if any(r.chars for r in regions) and not kept:
        gone = {e: inside for e, inside in gone.items() if not inside}
        kept = [r for r in regions if r.chars]
    emptied = {r for r in regions if r not in kept}
    stack = [root]
    while stack:
        e = stack.pop()
        parts = []
        for p in e.parts:
            if not isinstance(p, str):
                if p in emptied or p in gone:
                    parts.append(Element(p.name if p not in emptied else "div", frozenset(), e))
                    continue
                stack.append(p)
            parts.append(p)
        e.parts = parts
    for e in reversed(_order(root)):
        e.holds_article = any(p.holds_article or _opens_article(p) for p in e.parts if not isinstance(p, str))


def _is_boilerplate(e: Element, inside: bool) -> bool:
    if e.name in _NO_ARTICLE:
        return True
    if e.holds_article or e.name in ("html", "body", "main"):
        return False
    if "hidden" in e.hints or e.name == "header" and not inside:
        return True
    if e.name == "article":  # a reader's comment; else no class word deletes an article
        return bool(e.hints & {"comment", "reply"})
    return bool(e.hints & _NO_CLASS) or any(h[5:] in _NO_ROLE for h in e.hints if h.startswith("role:")) or not inside and "header" in e.hints


def main_text(root: Element, template: frozenset | set) -> str:
    """The article's blocks joined by two line feeds; "" if none is left.  A
    template wants a hashed tree, which it is deleted from."""
    if template:
        delete_subtrees(root, template)
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        shown = _WHITE.sub(" ", "".join(run)).strip()
        if shown:
            blocks.append(shown)
        run.clear()

    def lay(start: Element, inside: bool) -> None:
        stack: list = [(start, inside)]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(_entities.unescape(item) if "&" in item else item)
            else:
                e, inside = item
                if e is not start and _is_boilerplate(e, inside):
                    if e.name in _BLOCK:
                        flush()
                    continue
                inside = inside or e.name in ("article", "main")
                if e.name in ("br", "wbr"):
                    run.append(" " if e.name == "br" else "")
                if e.name in _BLOCK:
                    flush()
                    stack.append(None)
                stack += [p if isinstance(p, str) else (p, inside) for p in reversed(e.parts)]
        flush()

    roots = _roots(root)
    for r in roots:
        lay(r, r.name in ("article", "main"))
    return "\n\n".join(blocks)


def _roots(root: Element) -> list[Element]:
    """Outermost articles; else main elements; else the whole page."""
    for names in (("article",), ("main",)):
        out, stack = [], [root]
        while stack:
            e = stack.pop()
            if e.parent and _is_boilerplate(e, False):
                continue
            if e.name in names:
                out.append(e)
                continue
            stack += [p for p in reversed(e.parts) if not isinstance(p, str)]
        if out:
            return out
    return [root]


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or None) if url else None
    except ValueError:
        return None


def template_subtrees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, key: subtrees that recur on at least LEAST_PAGES different pages of
    a host, see :func:`subtrees`.  A task sends each of them once a page, with
    its count; sums are taken in two steps, so that a menu that a host has on
    all its pages is no single task's work."""
    rows = pages.select(column(url).cast("string").alias("url"), column(html).cast("string").alias("html"))
    schema = pa.schema([("host", pa.string()), ("key", pa.binary()), ("inside", pa.bool_()), ("rest", pa.int64()), ("n", pa.int64())])

    def sent(seen: Counter):
        host, key, inside, rest = zip(*seen) if seen else ((), (), (), ())
        return batch_of(schema, host=list(host), key=list(key), inside=list(inside), rest=list(rest), n=list(seen.values()))

    def count(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "html"):
                for u, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                    host = host_of(u)
                    if host is None:
                        continue
                    root = parse(page or "")
                    hash_subtrees(root)
                    seen.update((host, *found) for found in subtrees(root))
                if len(seen) > 200_000:
                    yield sent(seen)
                    seen.clear()
        yield sent(seen)

    counts = rows.mapInArrow(count, "host string, key binary, inside boolean, rest long, n long")
    apart = counts.groupBy("host", "key", "inside", "rest").agg(F.sum("n").alias("n"))
    found = apart.groupBy("host", "key", "inside").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
    many = (F.col("different") >= LEAST_PAGES) & (~F.col("inside") | (F.col("different") >= LEAST_SHARE * F.col("n")))
    return found.where(many).select("host", "key", "inside")


def _held(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """host, page, keys: the template subtrees that a page holds; pages by hash."""
    schema = pa.schema([("host", pa.string()), ("page", pa.string()), ("key", pa.binary()), ("inside", pa.bool_())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                out = []
                for host, name, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                    if host is not None:
                        root = parse(page or "")
                        hash_subtrees(root)
                        out += [(host, name, key, inside) for key, inside in {(e.key, inside) for e, inside, _ in _deletable(root, _regions(root))}]
                yield batch_of(schema, **{f: [r[k] for r in out] for k, f in enumerate(schema.names)})

    keys = rows.select("host", "page", "html").mapInArrow(run, "host string, page string, key binary, inside boolean")
    return keys.join(templates, ["host", "key", "inside"]).groupBy("host", "page").agg(F.collect_set(F.struct("key", "inside")).alias("keys"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every page, rows one by one.

    A null page gives an empty text; a page without a host has no template;
    repeated rows give repeated results; an id that is no whole number is null.  Pages are parsed twice, so that no
    page is shuffled unless templates outgrow BROADCAST_TEMPLATES; then a page
    is joined with those of its own subtrees that are template.
    """
    spark = pages.sparkSession
    templates = materialize(template_subtrees(pages, url, html), "templates")
    rows = pages.select(F.expr(f"try_cast({_quoted(key)} AS bigint)").alias("page_id"), column(url).cast("string").alias("url"), column(html).cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    shared = None
    if templates.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set] = {}
        for r in templates.toLocalIterator():
            by_host.setdefault(r.host, set()).add((bytes(r.key), r.inside))
        shared = spark.sparkContext.broadcast(by_host)
    else:
        rows = rows.withColumn("host", F.udf(host_of, "string")("url")).withColumn("page", F.sha2("html", 256))
        rows = rows.join(_held(rows, templates), ["host", "page"], "left").drop("host", "page")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                urls = batch.column("url").to_pylist()
                template = [shared.value.get(host_of(u), ()) for u in urls] if shared else [{(bytes(k["key"]), k["inside"]) for k in keys or ()} for keys in batch.column("keys").to_pylist()]
                out = []
                for page, t in zip(batch.column("html").to_pylist(), template):
                    tree = parse(page or "")
                    if t:
                        hash_subtrees(tree)
                    out.append(main_text(tree, t))
                yield batch_of(schema, page_id=batch.column("page_id"), url=urls, text=out, n_chars=[len(t) for t in out])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
