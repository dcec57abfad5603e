"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are chains of element styles (tag, classes and id without numbers). For each node the pages give two distributions:
of the sequences of child styles, its presentation, and of the texts of its blocks, its content. What is alike on all pages has no entropy and no importance. The tree judges

* nodes: in one of low importance, the texts that many pages repeat are removed from every page of the host;
* branches, an element with all its descendants, where tag, role or class hint at a menu, header, footer, sidebar, notice or advert. The composite importance of a branch is that
  of its whole skeleton and its whole text, averaged with prior pages of none. A branch below BRANCH is removed with all that is in it; above, the hint does not hold.

Comments, forms and hidden elements are left out for what they are: their texts and structure vary like an article's, so importance cannot tell them apart. On a single page, too,
a hint does not hold for an element with the marked article or most of what the host does not repeat. Where a page marks its article, blocks outside are left out.

Equal pages count once for the tree. Statistics are gathered by (host, node, text) and added up before they are shuffled, so one host with a third of all pages is no bottleneck;
importance is per node, and only the texts to be removed (those on p of a low node's m pages with log(p) / log(m) of THRESHOLD or more) and the important branches come back to the
pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common

#: A node's importance is averaged over its pages and PRIOR pages more that would give it full importance; below the threshold it is low. Two pages are the least that can repeat
#: anything. PRESENTATION is the share of the presentation's importance.
PRIOR, THRESHOLD, PRESENTATION = 1, 0.5, 0.1
#: A hinted branch has PRIOR pages more without importance; skeleton and text count alike. Nearly every page must have its own for the hint not to hold.
BRANCH, SKELETON = 0.9, 0.5
#: Verdicts that are broadcast (8 bytes each); more meet the pages of their host in groups of so many pages.
BROADCAST_NODES, GROUP_PAGES = 200_000, 500

# Fixed values of the markup language, and words in classes, ids and roles.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements without text of the page, left out when they are closed; of svg and select only where no other block begins before, which would end them.
_QUIET = {t: re.compile(rf"<(/?){t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("noscript", "template", "annotation", "annotation-xml")}
_QUIET |= {t: re.compile(rf"<(?:(/?){t}|(?:{'|'.join(sorted(_BLOCK - {'option', 'optgroup', 'hr'}))}))(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("svg", "select")}
_CLOSES_P = _BLOCK - frozenset("body html button caption tbody td tfoot th thead tr legend option optgroup".split())
_HINT_TAGS = frozenset("nav aside footer form button dialog menu".split())
_HINT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot header masthead topbar banner ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login form search share sharing social related recommended widget widgets "
    "comment comments disqus replies reply respond discussion pagination pager toolbar copyright skip skiplink".split()
)
_KIND_WORDS = frozenset("comment comments disqus replies reply respond discussion login signup subscribe".split())
_KIND_TAGS = frozenset("form button dialog".split())
_HINT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_TOKEN = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?/][^>]*>?)", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Scope:
    """An element with a hint, or one marked as the main part: its hinted ancestor, and the weight of the texts that it holds. Hinted ones have a node and gather what is in them."""

    __slots__ = ("nth", "above", "weight", "node", "styles", "texts")

    def __init__(self, nth: int, above: _Scope | None, node: str | None = None):
        self.nth, self.above, self.weight, self.node, self.styles, self.texts = nth, above, 0, node, [], []


class _Element:
    __slots__ = ("tag", "path", "hint", "mark", "children", "block")

    def __init__(self, tag: str, path: str, hint: _Scope | None, mark: _Scope | None, block: int = 0):
        self.tag, self.path, self.hint, self.mark, self.children, self.block = tag, path, hint, mark, [], block


def _style(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """An element's style, whether a hint says that it isn't content, whether it is of a kind that never is, and whether it says that it is the main part."""
    found = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = [w.lower() for w in _NAME.findall(names)] if names != " " else []
    role = found.get("role", "").lower()
    unseen = "hidden" in found or found.get("aria-hidden") == "true"
    hinted = tag in _HINT_TAGS or role in _HINT_ROLES or not _HINT_WORDS.isdisjoint(words) or unseen
    if tag in ("body", "html", "main", "article") and role not in _HINT_ROLES:
        hinted = not {"comment", "comments", "reply", "replies", "ad", "advert", "sponsored", "related"}.isdisjoint(words) and tag == "article"
    kind = unseen or tag in _KIND_TAGS or role in ("form", "dialog", "alert") or not _KIND_WORDS.isdisjoint(words)
    return f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag, hinted, kind, role == "main" or tag in ("main", "article")


def blocks(source: str | None) -> tuple[list[tuple[str, str, _Scope | None, _Scope | None]], dict[str, tuple[str, ...]]]:
    """(path, text, innermost element with a hint, outermost marked element) of each block with text in page order, and the child styles of all elements of each path."""
    return parsed(source)[:2]


def parsed(source: str | None):
    """blocks(), and (node, skeleton, text) of each branch with a hint and text, the latter two as digests."""
    out: list[tuple[str, str, _Scope | None, _Scope | None]] = []
    stack = [_Element("", "", None, None)]
    scopes = 0
    text: list[str] = []
    styles: defaultdict[str, list[str]] = defaultdict(list)
    branches: list[tuple[str, str, str]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements by tag, as block is that of the innermost block: no step looks through a deep stack

    def flush() -> None:
        if text and (clean := " ".join("".join(text).split())):
            top, hint = stack[stack[-1].block], stack[-1].hint
            out.append((top.path, clean, hint, stack[-1].mark))
            if hint:
                hint.texts.append(clean)
        text.clear()

    def add(piece: str) -> None:
        text.append(html.unescape(piece) if "&" in piece else piece)  # piece by piece: tags end a reference

    def push(e: _Element) -> None:
        places[e.tag].append(len(stack))
        stack.append(e)

    def pop() -> None:
        e = stack.pop()
        places[e.tag].pop()
        styles[e.path].append(",".join(e.children))
        if e.hint is not stack[-1].hint:  # a branch ends: what holds it gets its digests
            skeleton, whole = (_digest(x) for x in (e.hint.styles, e.hint.texts))
            if e.hint.texts:
                branches.append((e.hint.node, skeleton, whole))
            if e.hint.above:
                e.hint.above.styles.append(skeleton)
                if e.hint.texts:
                    e.hint.above.texts.append(whole)
            e.hint.styles = e.hint.texts = ()

    def close(tags, stop=frozenset()) -> None:
        """Ends the innermost open element of these tags, if none of stop is inside."""
        k = max((places[t][-1] for t in tags if places[t]), default=0)
        if not k or (stop is _BLOCK and stack[-1].block > k) or (stop is not _BLOCK and any(places[t] and places[t][-1] > k for t in stop)):
            return
        if stack[-1].block >= k:
            flush()
        while len(stack) > k:
            pop()

    source = source or ""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        if lt > at:
            add(source[at:lt])
        m = _TOKEN.match(source, lt)
        if not m and not (m := _LOOSE_TAG.match(source, lt)):
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        groups = m.groups()
        end, tag, attributes = groups[-3], groups[-2], groups[-1]
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                text.append(" ")
            elif tag == "p" and not places["p"]:
                flush()
            elif tag not in ("body", "html"):
                close({tag}, frozenset() if tag in _BLOCK else _BLOCK)
            continue
        if tag in _RAW:
            found = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
            if tag == "xmp":  # shown as it stands
                flush()
                text.append(source[at : found.start() if found else n])
                flush()
            at = found.end() if found else n
            continue
        if tag in _QUIET:
            if not attributes.endswith("/") and (found := _QUIET[tag].search(source, at)) and found[1]:
                at = found.end()
            continue
        if tag == "head" or tag in _VOID:
            if tag in ("br", "hr", "img"):
                flush() if tag == "hr" else text.append(" ")
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"button", "table", "td", "th"})
        if tag in _ENDS:
            close(set(_ENDS[tag][0].split()), _ENDS[tag][1])
        if tag in _BLOCK:
            flush()
        style, hinted, kind, inside = _style(tag, attributes)
        parent = stack[-1]
        if tag == "header" and parent.mark:
            hinted = False  # of the article itself
        elif tag == "header":
            hinted = True
        parent.children.append(style)
        above = parent.path if len(parent.path) < 400 else hashlib.sha1(parent.path.encode("utf-8", "replace")).hexdigest()
        path = f"{above}>{style}" if tag in _BLOCK else parent.path
        scopes += 1
        marked = inside and not hinted and not parent.mark
        hint, mark = _Scope(scopes, parent.hint, f"{above}>{style}{'!' * (kind + 1)}") if hinted else parent.hint, _Scope(scopes, parent.hint) if marked else parent.mark
        if hint:
            hint.styles.append(style)
        push(_Element(tag, path, hint, mark, len(stack) if tag in _BLOCK else parent.block))
    flush()
    while len(stack) > 1:
        pop()
    return out, {path: tuple(x) for path, x in styles.items()}, branches


def _digest(parts) -> str:
    return hashlib.sha1("\0".join(parts).encode("utf-8", "replace")).hexdigest()


def _chain(scope: _Scope | None) -> Iterator[_Scope]:
    while scope:
        yield scope
        scope = scope.above


def _candidates(found: list[tuple[str, str, _Scope | None, _Scope | None]], repeated: list[bool] | None = None, important=frozenset()) -> list[tuple[str, str]]:
    """(path, text) of the blocks that hints leave: those of the article if one is marked, else all. Texts weigh their length, those that the host repeats nothing.

    A hint does not hold for an element with more than half of that weight (of the article's, if one is marked), nor for those around a marked article that weighs more than
    all that is free of hints, nor for branches that the tree finds important. If hints leave nothing, the texts that the host does not repeat stay.
    """
    weights = [0 if repeated and repeated[k] else len(t) for k, (_, t, _, _) in enumerate(found)]
    void: set[int] = set()  # hints that do not hold
    marks = {m.nth: m for _, _, _, m in found if m}
    if marks and all(m.above for m in marks.values()):
        for m in marks.values():
            m.weight = 0
        for w, (_, _, h, m) in zip(weights, found, strict=True):
            if m and h is m.above:
                m.weight += w
        best = max(marks.values(), key=lambda m: (m.weight, -m.nth))
        if best.weight > sum(w for w, (_, _, h, _) in zip(weights, found, strict=True) if not h):
            void.update(h.nth for h in _chain(best.above))
    hints: dict[int, _Scope] = {}
    for _, _, h, _ in found:
        while h and h.nth not in hints:
            hints[h.nth], h.weight = h, 0
            h = h.above
    void.update(h.nth for h in hints.values() if h.node in important)
    free = {m.nth for m in marks.values() if not m.above or m.above.nth in void}
    scope = [bool(m) and m.nth in free for _, _, _, m in found]
    if not any(w for w, inside in zip(weights, scope, strict=True) if inside):
        weighed = weights
    else:
        weighed = [w if inside else 0 for w, inside in zip(weights, scope, strict=True)]
    for w, (_, _, h, _) in zip(weighed, found, strict=True):
        if h:
            h.weight += w
    total, gone = sum(weighed), set()
    for nth in sorted(hints, reverse=True):  # inner ones first
        h = hints[nth]
        if h.above:
            h.above.weight += h.weight
    for nth in sorted(hints):
        h = hints[nth]
        if (h.above and h.above.nth in gone) or (nth not in void and 2 * h.weight <= total):
            gone.add(nth)
    kept = [k for k, (_, _, h, _) in enumerate(found) if not h or h.nth not in gone]
    kept = [k for k in kept if scope[k]] or kept or [k for k, w in enumerate(weights) if w]
    return [found[k][:2] for k in kept]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _branch(node: str) -> int:
    return _hash(f"branch\0{node}")


def _rows(pages: DataFrame) -> DataFrame:
    """(host, node, text, style, page, branch), distinct, of every block and every hinted branch of rows (host, html); text is a hash of the node's path and the text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                page = _hash(source or "")
                found, styles, branches = parsed(source)
                shapes = {path: (_hash(path), _hash("\0".join(styles.get(path, ())))) for path, *_ in found}
                for path, text, *_ in found:
                    node, shape = shapes[path]
                    out.add((host, node, _hash(f"{path}\0{text}"), shape, page, False))
                skeletons = defaultdict(list)  # a page has one skeleton per branch, that of all its elements
                for node, skeleton, _ in branches:
                    skeletons[node].append(skeleton)
                skeletons = {node: _hash("\0".join(x)) for node, x in skeletons.items()}
                for node, _, whole in branches:
                    if not node.endswith("!!"):  # kinds are not judged
                        out.add((host, _branch(node), _hash(whole), skeletons[node], page, True))
            yield pd.DataFrame(list(out), columns=["host", "node", "text", "style", "page", "branch"])

    return pages.mapInPandas(scan, "host string, node long, text long, style long, page long, branch boolean").distinct()


def _texts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host", "node", "branch", "text").agg(F.count("*").alias("p"))  # a page has one style per node, so a text once


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, branch, pages, presentation, content, importance) of the site style trees of rows (host, html)."""
    return _tree(_rows(pages))


def _tree(rows: DataFrame) -> DataFrame:
    texts = _texts(rows)
    shapes = rows.select("host", "node", "branch", "style", "page").distinct().groupBy("host", "node", "branch", "style").agg(F.count("*").alias("c"))
    shapes = shapes.groupBy("host", "node", "branch").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    content = texts.groupBy("host", "node", "branch").agg(F.sum("p").alias("n"), F.sum(F.col("p") * F.log("p")).alias("plogp"))
    both = shapes.join(content, ["host", "node", "branch"])
    # Entropies to the base of the number of pages: of a text over its p pages log(p) / log(m); of the styles over the pages (log(m) - sum(c log c) / m) / log(m).
    m = F.log(F.greatest(F.col("pages"), F.lit(2)))
    both = both.withColumn("presentation", (F.log("pages") - F.col("clogc") / F.col("pages")) / m).withColumn("content", 1 - F.col("plogp") / F.col("n") / m)
    share = F.when(F.col("branch"), SKELETON).otherwise(PRESENTATION)
    return both.withColumn("importance", share * F.col("presentation") + (1 - share) * F.col("content")).drop("clogc", "plogp", "n")


def _verdicts(rows: DataFrame) -> DataFrame:
    """(host, repeated, low, important): hashes of the texts to remove, and of the branches on either side of BRANCH, of hosts with any."""
    found = common.written(rows)  # pages are parsed once for it
    tree = common.written(_tree(found).where("pages > 1"))
    smooth = (F.col("pages") * F.col("importance") + F.when(F.col("branch"), 0).otherwise(PRIOR)) / (F.col("pages") + PRIOR)
    low = common.small(tree.where(~F.col("branch") & (smooth < THRESHOLD)).select("host", "node", "branch", "pages"))  # broadcast, the texts of a frequent node stay spread
    many = (F.col("p") > 1) & (F.log("p") >= THRESHOLD * F.log("pages"))
    repeated = _texts(found).join(low, ["host", "node", "branch"]).where(many).select("host", F.col("text").alias("repeated"))
    branches = tree.where("branch").select("host", F.when(smooth < BRANCH, F.col("node")).alias("low"), F.when(smooth >= BRANCH, F.col("node")).alias("important"))
    both = repeated.unionByName(branches, allowMissingColumns=True).groupBy("host")
    return common.written(both.agg(*[F.collect_set(c).alias(c) for c in ("repeated", "low", "important")]))


_NONE = (frozenset(),) * 3


def _main_text(source: str | None, verdicts=_NONE) -> tuple[str, int, int]:
    """The main text of a page, how many blocks the tree's verdicts on repeated texts and low branches remove, and how many go besides."""
    (found, _, _), (repeated, low, important) = parsed(source), verdicts
    of = {x: bool(repeated) and _hash(f"{x[0]}\0{x[1]}") in repeated for x in {f[:2] for f in found}}
    scopes: dict[int, _Scope] = {}
    for *_, scope, _ in found if low or important else ():
        while scope and scope.nth not in scopes:
            scopes[scope.nth], scope = scope, scope.above
    branches, inside = {h.node: _branch(h.node) for h in scopes.values()}, {}
    for nth in sorted(scopes):  # outer ones first
        h = scopes[nth]
        inside[nth] = branches[h.node] in low or bool(h.above and inside[h.above.nth])
    kept = _candidates(found, [of[f[:2]] for f in found], {node for node, x in branches.items() if x in important})
    kept = [x for x in kept if not of[x]] or kept
    left = defaultdict(int)
    for x in kept:
        left[x] += 1
    tree = 0
    for path, text, hint, _ in found:
        if left[path, text]:
            left[path, text] -= 1
        else:
            tree += of[path, text] or bool(hint and inside.get(hint.nth))
    return "\n\n".join(t for _, t in kept), tree, len(found) - len(kept) - tree


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_tree, n_other) per page row: the blocks of the main text in page order, joined by two newlines, empty if there is none; how many blocks went
    as texts that the tree found repeated or in branches that it found low, and how many went besides: comments, forms, hints on a host's only page, blocks outside the article.

    A null page is empty; a null url makes a host of its own. A page whose blocks would all be removed keeps what the hints left. Repeated rows give repeated results; other
    columns are ignored; pages are parsed whole. On a host with a single distinct page nothing can be told to be repeated and branches have no importance; on one with few pages a
    text that most of them share counts as boilerplate, also where it is an article that they all carry.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html")).withColumn("host", host_of(F.col("url")))
    verdicts = _verdicts(_rows(rows.select("host", "html")))
    columns = ["text", "n_tree", "n_other"]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, url string, text string, n_chars long, n_tree long, n_other long"

    def cut(pdf: pd.DataFrame, of) -> pd.DataFrame:
        out = pd.DataFrame([_main_text(source, of(host)) for host, source in zip(pdf["host"], pdf["html"], strict=True)], columns=columns, index=pdf.index)
        return pd.concat([pdf[["key", "url"]], out], axis=1).assign(n_chars=out["text"].map(len))[["key", "url", "text", "n_chars", "n_tree", "n_other"]]

    if (verdicts.agg(F.sum(F.size("repeated") + F.size("low") + F.size("important"))).first()[0] or 0) <= BROADCAST_NODES:
        known = spark.sparkContext.broadcast({r["host"]: tuple(map(frozenset, r[1:])) for r in verdicts.collect()})

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield cut(pdf, lambda host: known.value.get(host, _NONE))

        out = rows.mapInPandas(each, schema)
    else:
        groups = common.written(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).alias("groups")))
        dealt = rows.withColumn("nth", F.monotonically_increasing_id()).join(groups, "host").withColumn("part", F.pmod("nth", "groups"))
        told = verdicts.join(groups, "host").withColumn("part", F.explode(F.expr("sequence(0, groups - 1)"))).select("host", "part", "repeated", "low", "important")

        def together(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            own = tuple(map(frozenset, told[["repeated", "low", "important"]].iloc[0])) if len(told) else _NONE
            return cut(pdf, lambda host: own)

        out = dealt.groupBy("host", "part").cogroup(told.groupBy("host", "part")).applyInPandas(together, schema)
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
