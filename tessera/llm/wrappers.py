"""Main texts of web pages by wrappers: union-free regular expressions that are inferred from the pages of a host.

A page is read as a stream of tokens, tags and texts. Equal neighbours in it become repeated groups; then the streams of a host are
aligned one after the other: where two of them differ in a text it becomes a slot, where one has what the other lacks an optional
group, and where that repeats what stands beside it a repeated group. What is left is the host's wrapper. Its slots know how many
pages fill them, with how much text, how much of it in links, and whether it is always the same. From that and from the names of
the elements around it a slot is found to hold main text or not, and a page's text is what it puts into such slots.

Alignment is a partial aggregate: each task aligns the pages that it reads, host by host, and hands on one wrapper a host;
wrappers are aligned with one another in rounds of at most FAN a group, so that no host, however large, goes through one task.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, release, sliced, written

#: Wrappers of a host that are aligned in one group.
FAN = 64
#: Hosts with more than one in so many pages (so many hosts at most) have their wrappers broadcast.
HOT = 100
#: Levels of nesting; elements further in stand beside each other on the last one.
DEPTH = 120
#: Children, each with each, that are aligned exactly; longer sequences by the order of their labels.
PAIRS = 250_000
#: Children from which on the names of classes no longer tell elements apart.
WIDE = 200
#: Wrappers, and signatures of pages for each, whose main text a task remembers.
KNOWN = 128
#: Nodes of the wrappers that a task holds before it hands them on.
HELD = 200_000

# Fixed values of HTML: elements by what they do to a page's flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words by which elements say what they hold.
NO_TEXT = frozenset("head nav header footer aside form button select option textarea input dialog menu svg object audio video canvas map fieldset".split())
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter newsletters "
    "subscribe subscription signup menu menus nav navbar navigation navi topbar breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations share sharing shares social comment comments commentlist reply replies respond responses "
    "disqus discussion feedback footer footnav colophon masthead pagination pager pagenav toolbar login search skip hidden copyright disclaimer toc tagcloud tags byline".split()
)
HEADER = frozenset("header head topnav".split())
CONTENT = frozenset("article articlebody post posts entry story content main body text maincontent".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|noembed|noframes|xmp|title|textarea)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A part of a wrapper, or of a page's stream: an element with its children, a group of them in brackets, or a text ("#").

    many: it may repeat; opt: it may be missing. pages that have it; of texts also their number, characters, those in links, and
    same, the hash of what they all are (0 if they differ). runs: the texts of the page. keep: whether they are main text."""

    __slots__ = ("label", "kids", "many", "opt", "pages", "texts", "chars", "links", "same", "runs", "keep", "_shape")

    def __init__(self, label: str, kids: list[Node] | None = None, many: bool = False, opt: bool = False, pages: int = 1, texts: int = 0, chars: int = 0, links: int = 0, same: int = 0):
        self.label, self.kids, self.many, self.opt, self.pages, self.texts, self.chars, self.links, self.same = label, kids if kids is not None else [], many, opt, pages, texts, chars, links, same
        self.runs: list[int] = []
        self.keep, self._shape = False, None

    def shape(self) -> frozenset:
        """What is in it, three levels down: tells whether two elements without names are alike."""
        if self._shape is None:
            found = set()
            for k in self.kids:
                found.add(k.label)
                if k.kids:
                    found |= {f"{k.label}>{x.label}" for x in k.kids}
                    found |= {f"{k.label}>{x.label}>{y.label}" for x in k.kids for y in x.kids}
            self._shape = frozenset(found)
        return self._shape

    def packed(self, flags: bool = False) -> list:
        own = [int(self.keep)] if flags else [self.pages, self.texts, self.chars, self.links, self.same]
        return [self.label, self.many * 2 + self.opt, own, [k.packed(flags) for k in self.kids]]


def unpacked(packed: list) -> Node:
    label, how, own, kids = packed
    node = Node(label, [unpacked(k) for k in kids], bool(how & 2), bool(how & 1))
    if len(own) == 1:
        node.keep = bool(own[0])
    else:
        node.pages, node.texts, node.chars, node.links, node.same = own
    return node


# --- pages as streams ---------------------------------------------------------------------------------------------------------


def _label(tag: str, attributes: str) -> str:
    """The element's name with its classes and ids (numbers in them as 0), and with what else says what it is for."""
    if not attributes:
        return tag
    names = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id", "itemprop"):
            names += re.sub(r"\d+", "0", references.unescape(value)).split()
        elif name == "role":
            names.append(f"role={value.lower()}")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            names.append("hidden")
    return ".".join([tag, *sorted(set(names))])


def _words(label: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(label.partition(".")[2])}


def said(label: str) -> str:
    """What an element's name says: "out" (not main text), "in" (it holds it), or nothing."""
    tag = label.partition(".")[0]
    if tag in ("html", "body", "#", "("):
        return ""
    if tag in NO_TEXT:
        return "out"
    if "." in label:
        role = label.partition("role=")[2].partition(".")[0]
        words = _words(label)
        if role in ASIDE_ROLES or words & ASIDE and tag not in ("main", *HEADINGS) and not (tag == "article" and not words & {"comment", "comments", "reply", "ad", "ads", "promo", "related", "sponsored"}):
            return "out"
        if words & HEADER and not words & CONTENT and tag not in HEADINGS:
            return "out"
        if role == "main" or words & {"articlebody"}:
            return "in"
    return "in" if tag in ("article", "main") else ""


def stream(page: str) -> tuple[Node, list[str]]:
    """The page's elements that make blocks, and its texts in order: what stands between two of their tags is one text, with
    the character references decoded and white space made one blank. A text is of the element that it stands in."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    runs: list[str] = []
    parts: list[str] = []
    state = [0, 0]  # links open, characters in links

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                here = stack[-1][1]
                leaf = Node("#", None, texts=1, chars=len(text), links=min(state[1], len(text)), same=zlib.crc32(text.encode("utf-8", "replace")) or 1)
                leaf.runs.append(len(runs))
                runs.append(text)
                here.kids.append(leaf)
            parts.clear()
        state[1] = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]
        state[0] = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if state[0]:
                state[1] += len(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            ended = m["end"] is not None
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                state[0] = 0 if ended else 1
            label = "" if ended or not m["attr"] or tag in VOID else _label(tag, m["attr"])
            if label and said(label) == "out":  # an inline element that isn't text
                flush()
                if len(stack) < DEPTH:
                    node = Node(label)
                    stack[-1][1].kids.append(node)
                    stack.append((tag, node))
            elif ended and stack[-1][0] == tag:
                close(len(stack) - 1)
            continue
        if m["end"] is not None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in CLOSED_BY:
            closed, within = (x.split() for x in CLOSED_BY[tag])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in closed:
                    close(i)
                    if tag in ("li", "td", "th", "dt", "dd", "option"):
                        break
        flush()
        if tag in ("html", "body") or tag in VOID:
            continue
        node = Node(_label(tag, m["attr"]))
        stack[-1][1].kids.append(node)
        if len(stack) < DEPTH and not m["attr"].endswith("/"):
            stack.append((tag, node))
    flush()
    return root, runs


# --- alignment ----------------------------------------------------------------------------------------------------------------

_PLAIN = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre option html head thead tbody article main nav footer header aside".split())


def alike(a: Node, b: Node) -> float:
    """How well two nodes fit each other, 0 to 1. A name, or an element that says what it is, is enough; others have to hold
    similar things."""
    if a.label != b.label:
        return 0.0
    if a.label in _PLAIN or a.label in "#(" or "." in a.label:
        return 1.0
    x, y = a.shape(), b.shape()
    return 1.0 if x == y else len(x & y) / len(x | y)


def merged(a: Node, b: Node, across: bool) -> Node:
    """One node for both: of two pages (across), or of one that repeats it."""
    out = Node(a.label, _aligned(a.kids, b.kids, across), a.many or b.many or not across, a.opt or b.opt, a.pages + b.pages if across else max(a.pages, b.pages))
    out.texts, out.chars, out.links, out.same = a.texts + b.texts, a.chars + b.chars, a.links + b.links, a.same if a.same == b.same else 0
    out.runs = a.runs + b.runs
    return out


def pairs(a: Sequence[Node], b: Sequence[Node]) -> list[tuple[int, int]]:
    """The best alignment of two sequences, in order: the pairs that are one."""
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)) and all(alike(x, y) >= 0.5 for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > PAIRS:  # by the order of labels
        places: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            places.setdefault(b[j].label, []).append(j)
        out, after = [], -1
        for i, x in enumerate(a):
            at = places.get(x.label, [])
            while at and at[-1] <= after:
                at.pop()
            if at:
                after = at.pop()
                out.append((i, after))
        return out
    fit = [[s if (s := alike(x, y)) >= 0.5 else 0.0 for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, f = best[i], best[i + 1], fit[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + f[j] if f[j] else 0.0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if fit[i][j] and best[i][j] == best[i + 1][j + 1] + fit[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list[Node], b: list[Node], across: bool) -> list[Node]:
    """Both sequences as one: what fits is merged, the rest is optional."""
    if not a and not b:
        return []
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    out: list[Node] = []
    i = j = 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        for k in [*a[i:x], *b[j:y]]:
            k.opt = True
            out.append(k)
        if x < len(a):
            out.append(merged(a[x], b[y], across))
        i, j = x + 1, y + 1
    if len(out) > WIDE:
        for k in out:
            if "." in k.label and not said(k.label):
                k.label = k.label.partition(".")[0]
    return folded(out)


def _group_labels(group: Node) -> list[str]:
    return [k.label for k in group.kids]


def _grouped_like(kids: list[Node], other: list[Node]) -> list[Node]:
    """What `other` has as a repeated group, grouped here, too, where it stands once."""
    for g in other:
        if g.label == "(":
            want, i, out = _group_labels(g), 0, []
            while i < len(kids):
                if kids[i].label != "(" and [k.label for k in kids[i : i + len(want)]] == want:
                    out.append(Node("(", kids[i : i + len(want)], pages=max(k.pages for k in kids[i : i + len(want)])))
                    i += len(want)
                else:
                    out.append(kids[i])
                    i += 1
            kids = out
    return kids


def folded(kids: list[Node]) -> list[Node]:
    """A sequence with what repeats made groups: neighbours that are alike, then sequences of two to six that follow each
    other with equal labels."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label and alike(out[-1], k) >= 0.5 and _same_group(out[-1], k):
            opt = out[-1].opt and k.opt
            out[-1] = merged(out[-1], k, False)
            out[-1].opt = opt
        else:
            out.append(k)
    for size in range(2, 7):
        if len(out) < 2 * size:
            break
        labels = [k.label for k in out]
        i, done = 0, []
        while i < len(out):
            if labels[i : i + size] == labels[i + size : i + 2 * size] and "(" not in labels[i : i + size] and len(labels) >= i + 2 * size:
                group = Node("(", out[i : i + size], True, pages=max(k.pages for k in out[i : i + size]))
                i += size
                while labels[i : i + size] == _group_labels(group):
                    group.kids = [merged(x, y, False) for x, y in zip(group.kids, out[i : i + size], strict=True)]
                    for k in group.kids:
                        k.many = False
                    i += size
                done.append(group)
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def _same_group(a: Node, b: Node) -> bool:
    return a.label != "(" or _group_labels(a) == _group_labels(b)


def prepared(node: Node) -> Node:
    """A page's stream with its repetitions folded, from the inside out."""
    node.kids = folded([prepared(k) if k.kids else k for k in node.kids])
    return node


def signature(node: Node) -> str:
    """All of a stream but its texts."""
    return node.label + "?+*"[node.opt + 2 * node.many - 1 : node.opt + 2 * node.many or 0] + (f"<{' '.join(map(signature, node.kids))}>" if node.kids else "")


def added(a: Node, b: Node) -> None:
    """Counts a page of the same signature in."""
    a.pages += b.pages
    a.texts, a.chars, a.links = a.texts + b.texts, a.chars + b.chars, a.links + b.links
    if a.same != b.same:
        a.same = 0
    for x, y in zip(a.kids, b.kids, strict=True):
        added(x, y)


def aligned(wrappers: Sequence[Node]) -> Node:
    """One wrapper for all, aligned one after the other."""
    first, *rest = wrappers
    for w in rest:
        first = merged(first, w, True)
        first.many = False
    return first


# --- what holds main text -----------------------------------------------------------------------------------------------------


def _leaves(node: Node) -> Iterator[Node]:
    if node.label == "#":
        yield node
    for k in node.kids:
        yield from _leaves(k)


def _weight(node: Node) -> int:
    """Characters outside links of what may be main text."""
    if said(node.label) == "out":
        return 0
    own = max(0, node.chars - 2 * node.links) if node.label == "#" and not (node.same and node.pages > 2) else 0
    return own + sum(map(_weight, node.kids))


def _roots(node: Node) -> list[Node]:
    """The outermost elements that say that they hold the main text; within `main` its articles, if it has any."""
    kind = said(node.label)
    if kind == "out":
        return []
    inner = [r for k in node.kids for r in _roots(k)]
    if kind == "in":
        articles = [r for r in inner if r.label.partition(".")[0] == "article" and _weight(r)]
        return articles if articles and node.label.partition(".")[0] != "article" and sum(map(_weight, articles)) * 2 >= _weight(node) else [node]
    return inner


def _heaviest(node: Node) -> Node:
    """The innermost element with nearly all the text that may be main text."""
    weight = _weight(node)
    while weight:
        kid = max(node.kids, key=_weight, default=None)
        if kid is None or kid.label == "#" or kid.many or _weight(kid) < 0.7 * weight:
            break
        node = kid
    return node


def decide(root: Node) -> Node:
    """Sets `keep` of every text of a wrapper."""
    roots = [r for r in _roots(root) if _weight(r) or not _weight(root)]
    explicit = bool(roots)
    if not roots:
        roots = [_heaviest(root)]
    varied = any(x.same == 0 and x.pages > 2 for r in roots for x in _leaves(r))

    def mark(node: Node, heading: bool, above: Node) -> None:
        for k in node.kids:
            tag = k.label.partition(".")[0]
            if k.label == "#":
                plain = node.label.partition(".")[0]
                fixed = varied and k.same != 0 and k.pages > 2 and not heading and not (explicit and plain in _PLAIN)
                linked = k.links > 0.6 * k.chars and not heading and (not explicit or plain in ("li", "td", "div", "ul", "ol", "section") and k.texts > 1)
                k.keep = not fixed and not linked
            elif said(k.label) != "out":
                mark(k, heading or tag in HEADINGS, node)
            elif tag == "header" and explicit:  # an article's own header: its headings
                for x in k.kids:
                    if x.label.partition(".")[0] in HEADINGS:
                        mark(Node("", [x]), False, node)

    for r in roots:
        mark(r, False, r)
    return root


def kept_runs(wrapper: Node, page: Node) -> set[int]:
    """The texts of a page that stand in slots of main text. What the wrapper lacks is looked at by itself."""
    kept: set[int] = set()
    alone: list[Node] = []

    def walk(w: Node, p: Node) -> None:
        if p.label == "#":
            if w.keep:
                kept.update(p.runs)
            return
        ours, theirs = _grouped_like(p.kids, w.kids), w.kids
        met = dict((j, i) for i, j in pairs(theirs, ours))
        for j, k in enumerate(ours):
            if j in met:
                walk(theirs[met[j]], k)
            elif k.label == "(":
                flat = [x for x in theirs if x.label != "("]
                near = dict((b, a) for a, b in pairs(flat, k.kids))
                for b, x in enumerate(k.kids):
                    if b in near:
                        walk(flat[near[b]], x)
                    else:
                        alone.append(x)
            else:
                alone.append(k)

    walk(wrapper, page)
    if alone:
        decide(page)
        kept.update(i for node in alone for x in _leaves(node) if x.keep for i in x.runs)
    return kept


# --- Spark --------------------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without a port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _packed(node: Node, flags: bool = False) -> str:
    return json.dumps(node.packed(flags), separators=(",", ":"), ensure_ascii=False)


def inferred(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages and wrapper (JSON, with what holds main text marked): one row a host, over all pages that have html."""
    host = host_of(F.col(url_col)).alias("host")

    def partial(batches):
        seen: dict[str, dict[str, Node]] = {}
        held = 0

        def handed_on():
            # sorted, so that the order of rows within a task doesn't matter
            hosts = sorted(seen)
            made = [aligned([seen[h][s] for s in sorted(seen[h])]) for h in hosts]
            seen.clear()
            return pa.record_batch([pa.array(hosts, pa.string()), pa.array([m.pages for m in made], pa.int64()), pa.array(map(_packed, made), pa.string())], names=["host", "pages", "wrapper"])

        for b in sliced(batches, 1):
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                node = prepared(stream(text)[0])
                sign = signature(node)
                mine = seen.setdefault(h, {})
                if sign in mine:
                    added(mine[sign], node)
                else:
                    mine[sign] = node
                    held += sign.count(" ") + 1
            if held > HELD:
                yield handed_on()
                held = 0
        if seen:
            yield handed_on()
        release()

    def together(batches):
        """Sorted by host and bucket: the wrappers of each such group are aligned as they come."""
        at, node, n = None, None, 0
        for b in batches:
            out = []
            for h, bucket, count, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, bucket) != at:
                    if at is not None:
                        out.append((at[0], n, _packed(node)))
                    at, node, n = (h, bucket), unpacked(json.loads(w)), count
                else:
                    node, n = aligned([node, unpacked(json.loads(w))]), n + count
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "pages", "wrapper"])
        if at is not None:
            yield pa.record_batch([pa.array([at[0]]), pa.array([n], pa.int64()), pa.array([_packed(node)])], names=["host", "pages", "wrapper"])

    schema = "host string, pages long, wrapper string"
    found = written(pages.where(F.col(html_col).isNotNull()).select(host, F.col(html_col)).mapInArrow(partial, schema), "wrappers")
    while (most := found.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]) > 1:
        buckets = -(-most // FAN)
        order = found.withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.lit(buckets))).select("host", "bucket", "pages", "wrapper")
        grouped = order.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "wrapper")
        found = written(grouped.mapInArrow(together, schema), "wrappers")

    def decided(batches):
        for b in batches:
            marked = [_packed(decide(unpacked(json.loads(w))), True) for w in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(marked, pa.string())], names=["host", "pages", "wrapper"])

    return found.mapInArrow(decided, schema)


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """`pages` with the main text (blocks in page order, two line feeds between them) and its code points; columns of these
    names that are there already are replaced.

    Null or empty html gives an empty text. A null url is of the host without a name. Repeated rows stay, and have equal texts.
    Pages of any length are read whole; nested elements beyond DEPTH stand beside each other. An empty table gives an empty one.

    Pages are joined with their hosts' wrappers: hosts with more than one in HOT of all pages, so at most HOT hosts, have theirs
    broadcast and their pages stay where they are; those of other hosts are shuffled by host.
    """
    wrappers = written(inferred(pages, url_col, html_col), "wrappers-decided")
    every = wrappers.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first()["n"]
    kept = [c for c in pages.columns if c.lower() not in (text_col.lower(), size_col.lower())]
    source = pages if html_col in kept and url_col in kept else pages.select(*kept, *{url_col, html_col}.difference(kept))
    host, wrapper = fresh(source, "page_host"), fresh(source, "page_wrapper")
    hosted = source.withColumn(host, F.when(F.col(html_col).isNotNull(), host_of(F.col(url_col))))
    told = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper), (F.col("pages") * HOT > every).alias("hot"))
    hot = F.broadcast(told.where("hot").drop("hot"))
    cold = told.where("not hot").drop("hot")
    near = hosted.join(hot, host)
    far = hosted.where(F.col(host).isNotNull()).join(hot.select(host), host, "left_anti").join(cold.hint("shuffle_hash"), host)
    without = hosted.where(F.col(host).isNull()).withColumn(wrapper, F.lit(None).cast("string"))
    columns = [*source.columns, wrapper]
    joined = near.select(columns).unionByName(far.select(columns)).unionByName(without.select(columns))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(text_col, T.StringType()), T.StructField(size_col, T.LongType())])
    html_at, wrapper_at, kept_at = columns.index(html_col), len(columns) - 1, [columns.index(c) for c in kept]

    def run(batches):
        read: dict[str, tuple[Node, dict[bytes, set[int]]]] = {}
        for b in sliced(batches, html_at):
            texts = []
            for page, w in zip(b.column(html_at).to_pylist(), b.column(wrapper_at).to_pylist(), strict=True):
                if not page or w is None:
                    texts.append("")
                    continue
                if w not in read:
                    if len(read) >= KNOWN:
                        read.clear()
                    read[w] = unpacked(json.loads(w)), {}
                texts.append(_main_text(page, *read[w]))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([*(b.column(i) for i in kept_at), pa.array(texts, pa.string()), sizes], names=schema.names)

    return joined.mapInArrow(run, schema)


def _main_text(page: str, wrapper: Node, known: dict[bytes, set[int]]) -> str:
    """known: for signatures (their hashes) that were met before, which of a page's leaves, in order, hold main text."""
    node, runs = stream(page)
    node = prepared(node)
    sign = hashlib.blake2b(signature(node).encode("utf-8", "replace"), digest_size=16).digest()
    leaves = list(_leaves(node))
    if sign not in known:
        if len(known) >= KNOWN:
            known.clear()
        runs_kept = kept_runs(wrapper, node)
        known[sign] = {i for i, leaf in enumerate(leaves) if runs_kept.issuperset(leaf.runs)}
    return "\n\n".join(runs[r] for r in sorted(r for i in known[sign] for r in leaves[i].runs)).encode("utf-8", "replace").decode()


def op11_inferred_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(documents(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
