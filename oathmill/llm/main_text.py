"""HTML main text by equivalence classes of template tokens.

Tokens are elements known by their path (tags with class names, digits in names
counting as one sign, and the number of a container among like siblings). Over the
pages of a host each token has an occurrence vector: how often it stands on each
page. Vectors are compared by additive hashes, so they come from a plain
aggregation and never meet in one task. Tokens with one vector form an equivalence
class; a class is valid with support on SUPPORT of the host's pages, and is nested
in the class that holds its nearest enclosing token. The valid classes make the
host's template; tokens that stand once on each page of their class part these
pages into slots. Pages without elements are no pages of the template.

A token whose text never changes on STATIC_PAGES or more pages of different text is
template, not content. The main slot is, among the classes a page has, by how many
pages have them, the deepest slot with MAIN_SHARE of the text that differs between
pages. Hosts whose pages do not differ (fewer than three texts) have no template of
their own: the classes of all hosts' pages together decide. Where no class has such
a slot on a page, the deepest single container with MAIN_SHARE of the page's own
text is taken, else its ``article`` or ``main`` element, else all text that is not
static. Ties go to the deeper, then the later path in code point order. Slots are measured by the text outside noise, and
only where no slot has its share of that by all text; noise itself is a slot only on pages that have nothing else. Where
pages have one ``article`` (else one ``main``) outside noise, or one that encloses less deeply than all others, the slot is it
or lies in it, whatever stands beside it. Readers' comments in boxes without a name, on pages without such an element, are told from an article by
their share of the text alone.

Within the main slot all text counts except that of elements for menus, footers,
sidebars, notices, adverts, forms, scripts, styles and comments: HTML's own tags for
them, and containers (never paragraphs, headings or inline elements) with a class,
id or role that names one. The last word of a name counts (post-comments is comments,
related-work is work), less words for boxes (comment-list). A named element or a form
around LAYOUT_SHARE of the page's text is layout, unless its name is one of BESIDE_WORDS.

Character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined by a line feed in page order; empty blocks go. A
block ends where a block element or a line break does. Null and empty html have
text ''. A null url is of the host without a name. Repeated rows are extracted one
by one; they are one text among the host's. Long pages, open quotes and deep nesting
take time in proportion to their length. Extra columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stage, batched, sized_broadcast

SUPPORT, MAIN_SHARE, STATIC_PAGES, LAYOUT_SHARE = 0.2, 0.6, 3, 0.8
#: Paths up to this depth are spelled out; deeper ones are named by a hash, so that a path has a bounded size.
READABLE = 24
#: HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark math meter mi mn mo mrow ms msub msup mtext object output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks of running text: they fill a slot but are none themselves.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 hr li ul ol dl dt dd blockquote pre address figure figcaption".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are not the article, and last words of class names and ids that say so.
NOISE_TAGS = frozenset("nav aside footer form button select dialog menu head".split()) | RAW
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies footer masthead share sharing social related widget toolbar search login signup pagination pager".split())
#: Those of boxes that stand beside an article, however large they are.
BESIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo newsletter breadcrumb breadcrumbs comment comments disqus reply replies footer related pagination pager".split())
#: Words for boxes, which do not say what is in them.
BOX_WORDS = frozenset("area bar block box container form group inner item items list outer panel section slot thread unit wrap wrapper".split())
#: Words before a noise word that make it a property of the layout.
HAS_WORDS = frozenset("with without has have no hide show".split())
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)([^>\"'<]*)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


def noisy(names: str, known: frozenset[str] | None = None) -> bool:
    """Whether one of these class names and ids names noise (or one of the ``known`` words) by its last word."""
    known = NOISE_WORDS if known is None else known
    for name in names.split():
        words = [w for w in _PARTS.split(name) if w]
        while len(words) > 1 and words[-1] in BOX_WORDS:
            words.pop()
        if words and words[-1] in known and not (len(words) > 1 and words[-2] in HAS_WORDS):
            return True
    return False


@dataclass
class Page:
    """Elements in page order, parents first (-1: none), and events: (element, text) or (element, None) where a block ends."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    noise: list[bool] = field(default_factory=list)
    beside: list[bool] = field(default_factory=list)  # named as what stands beside an article, never around it
    events: list[tuple[int, str | None]] = field(default_factory=list)


def _tag_end(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Where the tag that begins before ``at`` ends (after its '>'), and whether quotes still count on this page.

    A quote that is never closed is a plain character. If quotes hide every '>' ahead they no longer count, so no
    stretch is searched to the end of the page twice.
    """
    if quotes:
        i = at
        while m := _STOP.search(page, i):
            if m[0] == ">":
                return m.end(), True
            closing = page.find(m[0], m.end())
            i = closing + 1 if closing >= 0 else m.end()
    end = page.find(">", at)
    return (end + 1 if end >= 0 else len(page)), False


def parse(page: str) -> Page:
    out, stack, opened = Page(), [], {}
    events, tags, parents, depths, paths, noise = out.events, out.tags, out.parents, out.depths, out.paths, out.noise
    siblings: list[dict[str, int]] = [{}]  # of the root and of each open element: containers by label
    at, size, quotes, last_end = 0, len(page), True, page.rfind(">")

    def pop() -> str:
        tag = tags[stack.pop()]
        siblings.pop()
        opened[tag] -= 1
        return tag

    here = 0  # text waits from here on
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end:
            break
        m = _PLAIN_TAG.match(page, begin)
        if m:
            end, rest = m.end(), m[3]
        else:
            m = _TAG_NAME.match(page, begin)
            if m:
                end, quotes = _tag_end(page, m.end(), quotes)
                rest = page[m.end() : end - 1]
            elif page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                end = end + 3 if end >= 0 else size
            elif page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin) + 1
            else:
                at = begin + 1
                continue
        if begin > here:
            events.append((stack[-1] if stack else -1, page[here:begin]))
        at = here = end
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                while pop() != tag:
                    pass
            if tag not in INLINE:
                events.append((stack[-1] if stack else -1, None))
            continue
        if tag not in INLINE:
            if opened.get("p") and tag != "br":  # a block ends an open paragraph
                while pop() != "p":
                    pass
            if stack and tags[stack[-1]] in CLOSES_ITSELF.get(tag, ()):
                pop()
            events.append((stack[-1] if stack else -1, None))
        if tag in VOID:
            continue
        names = " ".join(v.strip("\"'") for v in _NAMES.findall(rest)).lower() if "=" in rest else ""
        label = f"{tag}.{_DIGITS.sub('#', '.'.join(sorted(names.split())))}" if names else tag
        fills = tag in INLINE or tag in RUNNING
        if not fills:
            nth = siblings[-1][label] = siblings[-1].get(label, 0) + 1
            if nth > 1:
                label = f"{label}[{nth}]"
        parent = stack[-1] if stack else -1
        depth = depths[parent] + 1 if stack else 1
        full = f"{paths[parent]}>{label}" if stack else label
        stack.append(len(tags))
        siblings.append({})
        opened[tag] = opened.get(tag, 0) + 1
        tags.append(tag)
        parents.append(parent)
        depths.append(depth)
        paths.append(full if depth <= READABLE else f"~{xxhash.xxh3_64_hexdigest(full)}")
        out.beside.append(bool(names) and not fills and noisy(names, BESIDE_WORDS))
        noise.append(tag in NOISE_TAGS or (bool(names) and not fills and tag not in ("html", "body", "article", "main") and noisy(names)))
        if tag in RAW:
            found = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = found.start() if found else size
            here = at  # what stands in it is no text
            if not found:
                break
    if here < size:
        events.append((stack[-1] if stack else -1, page[here:]))
    _spare_layout(out)
    return out


def _spare_layout(page: Page) -> None:
    """Named elements and forms around nearly all of the page's text are layout."""
    if not any(page.noise):
        return
    chars = [0] * len(page.tags)
    whole = 0
    for at, raw in page.events:
        if raw is not None:
            n = len(raw.strip())
            whole += n
            if at >= 0:
                chars[at] += n
    for i in range(len(chars) - 1, -1, -1):
        if page.parents[i] >= 0:
            chars[page.parents[i]] += chars[i]
    for i, n in enumerate(chars):
        if page.noise[i] and not page.beside[i] and (page.tags[i] == "form" or page.tags[i] not in NOISE_TAGS) and whole and n >= LAYOUT_SHARE * whole:
            page.noise[i] = False


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return (m[1] if m else "").lower()


def measured(page: Page) -> tuple[dict[str, list], list[int], int]:
    """path -> [how often, characters of text below it, those not in noise, hash of the text, parent, tag, depth, whether it is noise]; both characters and the hash of the page."""
    n = len(page.tags)
    off = [False] * n  # in noise, or in a header outside articles
    raw_text = [False] * n  # in an element whose content is no text
    inside = [False] * n
    for i in range(n):
        p = page.parents[i]
        inside[i] = (p >= 0 and inside[p]) or page.tags[i] in ("article", "main")
        raw_text[i] = (p >= 0 and raw_text[p]) or page.tags[i] == "head" or page.tags[i] in RAW
        off[i] = (p >= 0 and off[p]) or page.noise[i] or (page.tags[i] == "header" and not inside[i])
    chars, clean, hashes = [0] * n, [0] * n, [0] * n
    whole, said = [0, 0], 0
    for at, raw in page.events:
        if raw is not None and (at < 0 or not raw_text[at]) and (text := raw.strip()):
            size, h = len(text), xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
            counts = at < 0 or not off[at]
            whole[0] += size
            whole[1] += size * counts
            said = (said * 3 + h) % 2**64
            if at >= 0:
                chars[at] += size
                clean[at] += size * counts
                hashes[at] = (hashes[at] * 3 + h) % 2**64
    found: dict[str, list] = {}
    for i in range(n - 1, -1, -1):
        p = page.parents[i]
        if p >= 0:
            chars[p] += chars[i]
            clean[p] += clean[i]
            hashes[p] = (hashes[p] + hashes[i] * 5) % 2**64
        token = found.get(page.paths[i])
        if token is None:
            found[page.paths[i]] = [1, chars[i], clean[i], hashes[i], page.paths[p] if p >= 0 else "", page.tags[i], page.depths[i], off[i]]
        else:
            token[0] += 1
            token[1] += chars[i]
            token[2] += clean[i]
            token[3] = (token[3] * 3 + hashes[i]) % 2**64
    return found, whole, said


_TOKENS = pa.schema([("host", pa.string()), ("path", pa.string()), ("parent", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("n", pa.int32()), ("chars", pa.int64()), ("clean", pa.int64()), ("whole", pa.int64()), ("whole_clean", pa.int64()), ("th", pa.int64()), ("v", pa.int64()), ("page", pa.int64())])


KINDS = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per token of each page; one with path '' for the page."""
    for batch in batches:
        rows = []
        for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
            u, text = url.as_py(), page.as_py() or ""
            found, whole, said = measured(parse(text))
            own = f"{u}\x00{xxhash.xxh3_64_intdigest(text.encode('utf-8', 'replace'))}\x00"
            h, said = host(u), said >> 33
            rows += [(h, p, up, tag, depth, n, c, cc, *whole, t >> 1, xxhash.xxh3_64_intdigest(f"{own}{n}".encode("utf-8", "replace")) >> 33, said) for p, (n, c, cc, t, up, tag, depth, _) in found.items()]
            if found:
                rows.append((h, "", None, None, 0, 1, *whole, *whole, 0, 0, said))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_TOKENS), _TOKENS, strict=True)], schema=_TOKENS)


def _vectors(tokens: DataFrame) -> DataFrame:
    square = (F.col("page") * F.col("page")).cast("decimal(38,0)")
    return tokens.groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.min("tag").alias("tag"), F.min("depth").alias("depth"), F.count("*").alias("pages"), F.sum("n").alias("times"), F.sum("v").alias("v1"),
        F.sum(F.col("v") * F.col("v") % 1_000_003).alias("v2"), *[F.sum(c).alias(c) for c in ("chars", "clean", "whole", "whole_clean")], F.min("th").alias("t1"), F.max("th").alias("t2"),
        F.min("page").alias("a"), F.max("page").alias("b"), F.sum("page").cast("decimal(38,0)").alias("s1"), F.sum(square).alias("s2"))


def _pooled(vectors: DataFrame) -> DataFrame:
    """The vectors of all hosts as one host '*': sums of sums."""
    low, high = ("parent", "tag", "depth", "t1", "a"), ("t2", "b")
    return vectors.groupBy("path").agg(*[(F.min if c in low else F.max if c in high else F.sum)(c).alias(c) for c in vectors.columns if c not in ("host", "path")]).withColumn("host", F.lit("*"))


def _differ() -> Column:
    """Whether the pages of a token have three texts or more: the sum of (page - a) * (b - page) is 0 if none lies between hashes a and b."""
    a, b = (F.col(c).cast("decimal(12,0)") for c in "ab")
    return (a + b) * F.col("s1").cast("decimal(24,0)") - F.col("s2") - a * b * F.col("pages").cast("decimal(12,0)") > 0


def templates(stage: Stage, pages: DataFrame) -> DataFrame:
    """host, texts (whether the pages differ), template: the valid classes' tokens; host '*' for all pages."""
    tokens = pages.select("url", "html").mapInArrow(batched(_tokens), ", ".join(f"{f.name} {KINDS[f.type]}" for f in _TOKENS))
    vectors = stage.write(_vectors(tokens), "vectors")
    vectors = stage.write(vectors.unionByName(_pooled(vectors)), "pooled")
    size = vectors.where("path = ''").select("host", F.col("pages").alias("host_pages"), _differ().alias("texts"))
    valid = vectors.where("path <> ''").join(sized_broadcast(size), "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    kind = F.xxhash64("v1", "v2", "pages", "times")  # tokens with one vector
    static = (F.col("t1") == F.col("t2")) & (F.col("pages") >= STATIC_PAGES) & _differ()
    token = F.struct("path", kind.alias("class"), (F.col("times") == F.col("pages")).alias("once"), static.alias("static"), "chars", "clean", "pages", (F.col("pages") == F.col("host_pages")).alias("everywhere"), "parent", "tag", "depth", "whole", "whole_clean")
    # at most 1 / SUPPORT times the tokens of a page
    return valid.groupBy("host").agg(F.max("texts").alias("texts"), F.sort_array(F.collect_list(token)).alias("template"))


def nested(tokens: list[dict]) -> dict[str, str | None]:
    """Each token's nearest enclosing token of another class: how the classes nest."""
    known = {t["path"]: t for t in tokens}
    out: dict[str, str | None] = {}
    for t in sorted(tokens, key=lambda t: t["depth"]):  # parents first
        up = known.get(t["parent"])
        out[t["path"]] = None if up is None else up["path"] if up["class"] != t["class"] else out[up["path"]]
    return out


def slots(tokens: list[dict]) -> tuple[list[str], list[str]]:
    """Paths of main slots, the class of most pages first, and of static elements, from a template."""
    known = {t["path"]: t for t in tokens}
    order = sorted(tokens, key=lambda t: t["depth"])
    under: dict[str, bool] = {}  # below a static element
    for t in order:
        up = known.get(t["parent"])
        under[t["path"]] = up is not None and (up["static"] or under[up["path"]])
    top = [t for t in tokens if t["static"] and t["depth"] > 1 and not under[t["path"]]]
    holders = set(nested(tokens).values())  # tokens that another class, of repeated ones, is nested in
    found: dict[int, tuple] = {}
    # where the pages have one article, the slot lies in it, whatever stands beside it
    anchor = only_article([(t["tag"], t["depth"], t["path"]) for t in tokens if t["once"] and not t["static"] and t["clean"] > 0])
    anchored, most, inside = set(), 0, (False, 0, "")
    for text, whole in (("clean", "whole_clean"), ("chars", "whole")):
        same = dict.fromkeys(known, 0)
        for t in top:
            same[t["path"]] = t[text]
        for t in reversed(order):
            if t["parent"] in same:
                same[t["parent"]] += same[t["path"]]
        for t in order:
            if not t["once"] or t["static"] or t["depth"] < 2 or t["tag"] in INLINE or t["tag"] in RUNNING or t["tag"] in ("html", "body", "head"):
                continue
            if t["whole_clean"] > 0 and t["clean"] == 0:  # noise is no slot where a page has anything else
                continue
            constant = sum(s[text] / s["pages"] * min(s["pages"], t["pages"]) for s in top)
            own = t[text] - same[t["path"]]
            rank = (t["path"] in holders, t["depth"], t["path"])
            if text == "clean" and own > 0 and (t["path"] == anchor or t["parent"] in anchored):
                anchored.add(t["path"])
                if t["path"] == anchor:
                    most = own
                if own >= MAIN_SHARE * most and t["pages"] >= known[anchor]["pages"] and rank[1:] > inside[1:]:
                    inside = rank
            if own > 0 and own >= MAIN_SHARE * (t[whole] - constant):
                if t["class"] not in found or rank > found[t["class"]][1]:
                    found[t["class"]] = (t["pages"], rank)
        if found:  # all text decides only where what is outside noise does not
            break
    ranked = [rank[2] for _, rank in sorted(found.values(), reverse=True)]
    return [inside[2]] * bool(inside[2]) + [p for p in ranked if p != inside[2]], sorted(t["path"] for t in top)


def only_article(marked: list[tuple[str, int, str]]) -> str | None:
    """The path of the one ``article`` (else ``main``) that no other of its kind stands beside, from (tag, depth, path) of those outside noise."""
    for tag in ("article", "main"):
        of = sorted((depth, path) for t, depth, path in marked if t == tag)
        if of and (len(of) == 1 or of[0][0] < of[1][0]):
            return of[0][1]
        if of:  # several articles are a page of them
            return None
    return None


def main_slot(tokens: list[dict]) -> str | None:
    """The path of the slot that holds the article on the pages of the most frequent class that has one."""
    return next(iter(slots(tokens)[0]), None)


def own_slot(page: Page) -> str | None:
    """The deepest single container with MAIN_SHARE of the page's own text, or of what is not noise."""
    found, wholes, _ = measured(page)
    anchor = only_article([(t[5], t[6], p) for p, t in found.items() if t[0] == 1 and not t[7] and t[2] > 0])
    for k, whole in ((1, wholes[1]), (0, wholes[0])):
        if k and anchor:
            whole = found[anchor][2]
        big = [(t[6], p) for p, t in found.items() if t[0] == 1 and whole and t[1 + k] >= MAIN_SHARE * whole and not t[7] and t[5] not in INLINE and t[5] not in RUNNING and t[5] not in ("html", "body")
               and (not (k and anchor) or p == anchor or p.startswith(anchor + ">"))]
        if big:
            return max(big)[1]
    return None


def extract(page: str, template: dict | None, pool: dict | None = None) -> str:
    """The text of a page, by its host's slots and static elements ({"slots", "static"}), or by those of all hosts."""
    tree = parse(page)
    has = set(tree.paths)
    slot = next((s for t in (template, pool) if t for s in t["slots"] if s in has), None) or own_slot(tree)
    static = set((template or pool or {"static": ()})["static"])
    n = len(tree.tags)
    tag = None if slot else "article" if "article" in tree.tags else "main" if "main" in tree.tags else ""
    kept, off = [False] * n, [False] * n
    for i in range(n):
        p = tree.parents[i]
        up = p >= 0 and kept[p]
        kept[i] = up or tree.paths[i] == slot or (tag is not None and tree.tags[i] == (tag or tree.tags[i]))
        off[i] = (p >= 0 and off[p]) or tree.noise[i] or (not slot and not tag and tree.paths[i] in static) or (tree.tags[i] == "header" and not (up and (slot or tag)))
        if tree.paths[i] == slot:  # what is around the slot is layout; a slot's own mark stays
            off[i] = tree.noise[i]
    blocks, parts = [], []

    def close() -> None:
        block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if block:
            blocks.append(block)
        parts.clear()

    for at, raw in tree.events:
        if raw is None:
            close()
        elif (kept[at] and not off[at]) if at >= 0 else not slot and not tag:
            parts.append(raw)
    close()
    return "\n".join(blocks)


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [json.dumps(dict(zip(("slots", "static"), slots(t.as_py()), strict=True))) for t in batch.column("template")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(plans, pa.string())], ["host", "plan"])


def _extracted(pool: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        every = json.loads(pool) if pool else None
        for batch in batches:
            texts = []
            for page, plan in zip(batch.column("html"), batch.column("plan"), strict=True):
                raw = plan.as_py()
                if raw and raw not in known:
                    if len(known) > 256:
                        known.clear()
                    known[raw] = json.loads(raw)
                texts.append(extract(page.as_py() or "", known[raw] if raw else None, None if raw and known[raw]["slots"] else every))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    stage = Stage(spark, "pages")
    known = templates(stage, pages).where("texts").select("host", "template")
    plans = stage.write(known.mapInArrow(_deduced, "host string, plan string"), "plans")
    row = plans.where("host = '*'").select("plan").first()  # one row
    own = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", own.alias("host")).join(sized_broadcast(plans.where("host <> '*'")), "host", "left")
    return rows.select("page_id", "url", "html", "plan").mapInArrow(batched(_extracted(row and row["plan"])), "page_id long, url string, text string, n_chars long")
