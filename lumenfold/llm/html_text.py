"""Main text of HTML pages: structure first, then boilerplate found by suffix arrays of each host's pages.

1. A page is read into blocks (paragraphs, headings, list items ...), each known to lie inside or outside an article
   container, with its share of link text. Elements that are boilerplate by tag, role, class or id are left out.
2. The words of a host's distinct pages (pages with equal streams count once) are concatenated, page ends apart, and their
   suffixes sorted by prefix doubling. Neighbours that share LONG words or more are repeated runs; whole blocks are, of any
   length. A run goes if enough distinct pages of its host have it; inside article containers that is half of the host's
   pages (a site-wide notice), so that articles that quote each other stay whole; elsewhere a few pages are enough.
3. A host of many words is dealt into groups of pages, each with its suffix array. A run on a tenth of the host's pages is
   on a tenth of some group's, so the groups' findings hold all that counts; they are then counted over the whole host.
4. Near copies stay: where runs cover most of a page, and most pages that have a run are such pages, the run is text.
5. Covered words go, the unique runs between them stay.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import lean, written

# Fixed values of HTML and of common page templates.
RAW = "script style noscript template textarea svg math iframe object canvas select option xmp noembed noframes".split()
DROPPED = {"nav", "footer", "aside", "form", "dialog", "button", "head", "title", "menu", "label", "input", "fieldset", "audio", "video", *RAW}
BLOCKS = set("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words that mark boilerplate as a whole class, id or role; the first line also as any word of one.
ALWAYS = set("ads advert adverts advertisement advertising adsense adslot breadcrumb breadcrumbs commentlist cookie cookies disqus gdpr navbar newsletter pagination popup sponsor sponsored".split())
NOISE = ALWAYS | set(
    "ad banner comment comments consent footer header masthead menu menubar modal nav navigation notice overlay pager promo promoted promotion recommended related "
    "replies reply search share sharing sidebar signup skip social subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing of a class's content: with only these beside it, a word above marks boilerplate.
GENERIC = set(
    "a area article articles bar block bottom box btn button buttons col column container content cta desktop fixed form global group home icon icons inner item items js left link links list "
    "main mobile module outer page panel post posts primary reader right row secondary section site slot small sticky stories top unit user wrap wrapper".split()
)
#: Words that turn a class into its opposite, or into a name of a layout.
LAYOUT = set("with without no not non has less layout hide hidden".split())
#: With these words a header is that of the text itself.
OWN_HEADER = set("post posts article articles entry story content".split())

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(hidden)\b""")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _marks(name: str) -> bool:
    """Does one class or id name boilerplate? Compounds do if their other words say nothing."""
    words = {w.lower() for w in WORDS.findall(name)}
    hit = words & NOISE
    if not hit or words & LAYOUT:
        return False
    if words & ALWAYS or hit == words:
        return True
    if "content" in words and hit <= {"sidebar"} or hit == {"header"} and words & OWN_HEADER:
        return False
    return words <= NOISE | GENERIC or all(w in NOISE or w in GENERIC or w.isdigit() for w in words)


def _noisy(attributes: str, classes: bool = True) -> bool:
    """Does a tag's class, id, role or state mark boilerplate?"""
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if classes and any(_marks(c) for c in value.split()):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


LISTS = {"ul", "ol", "dl", "menu", "table"}
FORM = re.compile(r"<(/?)form\b", re.I)


def _own_header(attributes: str) -> bool:
    """Is a header that of the text itself, by class or id?"""
    names = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if (m[1] or "").lower() in ("class", "id"))
    words = {w.lower() for name in names for w in WORDS.findall(name)}
    return "header" in words and bool(words & OWN_HEADER)


def _wrapping_forms(page: str) -> bool:
    """Do forms hold over half of the page's source? Then they may wrap the page, not just ask for something."""
    opened = held = 0
    start = 0
    for m in FORM.finditer(page):
        if m[1]:
            opened = max(0, opened - 1)
            if not opened:
                held, start = held + m.start() - start, m.start()
        else:
            if not opened:
                start = m.start()
            opened += 1
    return 2 * (held + (len(page) - start if opened else 0)) > len(page)


def blocks(page: str, classes: bool = True, forms: bool = False) -> list[tuple[str, bool, float, str]]:
    """(text, inside an article container, share of link text, kind) of a page's blocks, in page order. The kind is the name of
    the element that the block began in, or "li" for all that is in a list or table. With `forms`, forms and fieldsets are
    plain containers (their labels and controls go all the same)."""
    out: list[tuple[str, bool, float, str]] = []
    text: list[str] = []
    linked = total = 0
    kind, lists = "", 0
    dropped = DROPPED - {"form", "fieldset"} if forms else DROPPED
    inside = in_link = 0
    skip, depth = "", 0  # element that is being left out, and how many of its name are open
    nested = containers = 0  # articles opened inside it; article containers so far
    header = 0  # depth of headers inside articles: only headings count there
    heading = False
    at, n = 0, len(page)

    def close() -> None:
        nonlocal text, linked, total
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                out.append((s, inside > 0, linked / max(total, 1), "li" if lists else kind))
        text, linked, total = [], 0, 0

    def keep(s: str) -> None:
        nonlocal linked, total
        if s and not skip and (not header or heading):
            text.append(s)
            total += len(s)
            if in_link:
                linked += len(s)

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        keep(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:  # comment, doctype, processing instruction
            continue
        end, attributes, name = bool(m[1] or m[4]), m[3] or m[6] or "", name.lower()
        if name in RAW_END and not end:
            if not attributes.endswith("/"):
                stop = RAW_END[name].search(page, at)
                at = stop.end() if stop else n
            continue
        if skip:
            if name == skip:
                depth += -1 if end else 0 if name in VOID or attributes.endswith("/") else 1
            elif name in ("article", "main"):
                nested += -1 if end else 1
            # what was never closed ends with its container, or where the page's first article begins
            if nested < 0 or nested == 1 and not end and name in ("article", "main") and not containers and not _noisy(attributes, classes):
                skip, depth = "", 0
            elif depth == 0:
                skip = ""
                continue
            else:
                continue
        if name in BLOCKS or forms and name in ("form", "fieldset"):
            close()
            kind = "" if end else name
            if name in LISTS:
                lists = max(0, lists + (-1 if end else 1))
        if end:
            if name in ("article", "main"):
                inside = max(0, inside - 1)
            elif name == "a":
                in_link = max(0, in_link - 1)
            elif name == "header":
                header = max(0, header - 1)
            elif re.fullmatch("h[1-6]", name):
                heading = False
            continue
        if name == "br" or name in ("td", "th", "img"):
            keep(" ")
        if name in VOID or name == "br":
            continue
        if name in ("html", "body", "article", "main"):
            noisy = name == "article" and _noisy(attributes, classes)
        elif name == "header" and (inside or _own_header(attributes)):
            header, noisy = header + 1, False
        else:
            noisy = name in dropped or name == "header" or _noisy(attributes, classes)
        if noisy:
            if not attributes.endswith("/"):
                close()
                skip, depth, nested = name, 1, 0
        elif name in ("article", "main"):
            inside += 1
            containers += 1
        elif name == "a":
            in_link += 1
        elif re.fullmatch("h[1-6]", name):
            heading = True
    keep(page[at:])
    close()
    return out


#: Words of a paragraph that is all one link and still text, where no other links are about.
SENTENCE = 6


def candidates(page: str) -> list[tuple[str, bool]]:
    """Blocks that may be main text. Article containers, if they hold at least as much running text as all else: then their
    blocks, and the title and leads before the first of them. Else all blocks that are no links; a paragraph that is one link
    stays where no neighbour is mostly links. A form counts as a container if it wraps most of the page. Where classes leave
    nothing, they are not looked at."""
    found = blocks(page)
    if _wrapping_forms(page):
        wide = blocks(page, forms=True)
        if running_text(wide) > 2 * running_text(found):
            found = wide
    found = found or blocks(page, classes=False) or blocks(page, classes=False, forms=True)
    inside = sum(len(s) for s, article, _, _ in found if article)
    running = sum(len(s) for s, article, links, _ in found if not article and links <= 0.3 and len(s) >= 80)
    if inside and inside >= running:
        return [(s, True) for s in lead(found)] + [(s, True) for s, article, _, _ in found if article]
    mostly = [links > 0.6 for _, _, links, _ in found]
    alone = [not any(mostly[max(0, i - 1) : i] + mostly[i + 1 : i + 2]) for i in range(len(found))]
    return [(s, False) for (s, _, links, kind), link, one in zip(found, mostly, alone, strict=True) if not link or one and kind in ("p", "blockquote") and s.count(" ") >= SENTENCE - 1]


def running_text(found: list[tuple[str, bool, float, str]]) -> int:
    """Characters of blocks that are not mostly links and not in lists; headings and short ones count as well."""
    return sum(len(s) for s, _, links, kind in found if links <= 0.6 and kind != "li")


def lead(found: list[tuple[str, bool, float, str]]) -> list[str]:
    """Title and leads: of what comes before the first block in a container, the last first-order heading and, after it, headings
    and paragraphs without links; nothing without such a heading, or where the container has one."""
    first = next(i for i, b in enumerate(found) if b[1])
    start = next((i for i in range(first - 1, -1, -1) if found[i][3] == "h1"), None)
    if start is None or any(article and kind == "h1" for _, article, _, kind in found):
        return []
    return [s for s, _, links, kind in found[start:first] if links <= 0.3 and (kind == "p" or re.fullmatch("h[1-6]", kind))]


def digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Words of a run that counts without being a whole block, and of the grams its hash is made of.
LONG, GRAM = 24, 8
#: More row numbers than this go by a shuffled join.
MANY = 200_000


class Ids(dict):
    """Hashes of words, kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = n = digest(word)
        return n


def _rolled(x: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hash of every n elements that lie `step` apart."""
    m = len(x) - (n - 1) * step
    out = x[:m].copy()
    for j in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[j * step : j * step + m]
        out ^= out >> np.uint64(31)
    return out


def windows(blocks: list[str], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """(words by block, hash of every window of LONG words)."""
    words = [s.split(" ") for s in blocks]
    counts = np.array([len(w) for w in words], np.int64)
    if counts.sum() < LONG:
        return counts, np.empty(0, np.int64)
    x = np.fromiter((ids[w] for ws in words for w in ws), np.int64, counts.sum()).view(np.uint64)
    return counts, _rolled(_rolled(x, GRAM), LONG // GRAM, GRAM).view(np.int64)


def suffix_runs(x: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(suffix positions in sorted order, number of each one's interval) of all suffixes of x that share their first `depth`
    elements with another. Prefix doubling; suffixes that differ from all others leave the sort at once.

    An element that occurs once, such as the mark at a page's end, is in no interval.
    """
    n = len(x)
    rank = np.arange(n, 2 * n + 1)  # suffixes apart from all others keep a name of their own
    live, key, width = np.arange(n), x, 1
    while True:
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        last = np.append(new[1:], True)
        name = np.cumsum(new) - 1
        rank[live] = np.where(new & last, n + live, name)
        again = ~(new & last)
        live, name = live[again], name[again]
        if width >= depth or not len(live):
            return live, name
        step = min(width, depth - width)
        key = rank[live] * (2 * n + 1) + rank[np.minimum(live + step, n)]
        width += step


def group_keys(pages: list[list[str]], ids: Ids, least) -> list[tuple[int, int]]:
    """(key, pages) of the blocks and windows of LONG words that `least` or more of the group's pages have. Where one page is
    enough, that is all of them."""
    own = np.concatenate([np.unique(np.array([digest(s) for s in blocks], np.int64)) for blocks in pages])
    keys, n = np.unique(own, return_counts=True)
    found = list(zip(keys[n >= least].tolist(), n[n >= least].tolist(), strict=True))
    if least <= 1:
        own = np.concatenate([np.unique(windows(blocks, ids)[1]) for blocks in pages])
        return [*found, *zip(*(v.tolist() for v in np.unique(own, return_counts=True)), strict=True)]
    streams = [np.fromiter((ids[w] for s in blocks for w in s.split(" ")), np.int64) for blocks in pages]
    words = np.concatenate(streams)
    sizes = np.array([len(v) for v in streams])
    _, word = np.unique(words, return_inverse=True)
    page = np.repeat(np.arange(len(pages)), sizes + 1)
    at = np.arange(len(words)) + np.repeat(np.arange(len(pages)), sizes)
    x = np.empty(len(page), np.int64)
    x[np.cumsum(sizes + 1) - 1] = len(words) + np.arange(len(pages))  # page ends, each its own
    x[at] = word
    suffix, interval = suffix_runs(x)
    if len(suffix):
        pair = np.unique(interval * len(pages) + page[suffix])
        held, n = np.unique(pair // len(pages), return_counts=True)
        first = suffix[np.searchsorted(interval, held[n >= least])]
        run = words[(first - page[first])[:, None] + np.arange(LONG)].view(np.uint64)
        whole = np.array([_rolled(_rolled(r, GRAM), LONG // GRAM, GRAM)[0] for r in run], np.uint64).view(np.int64)
        found += zip(whole.tolist(), n[n >= least].tolist(), strict=True)
    return found


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are in sorted keys?"""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def covered(blocks: list[str], keys: np.ndarray, ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by block, which words lie in runs of the sorted keys, the keys met)."""
    counts, whole = windows(blocks, ids)
    own = np.array([digest(s) for s in blocks], np.int64)
    block, hit = _among(own, keys), _among(whole, keys)
    edges = np.zeros(counts.sum() + 1, np.int64)
    at = np.flatnonzero(hit)
    edges[at] += 1
    edges[at + LONG] -= 1
    return counts, np.repeat(block, counts) | (np.cumsum(edges)[:-1] > 0), np.unique(np.concatenate([own[block], whole[hit]]))


def by_host(rows: DataFrame, found: DataFrame, small: int) -> DataFrame:
    """rows with the found keys of their host, sorted, and the strong ones of these. Keys go by broadcast while they are at
    most `small`, else by a join. A host has at most ten times a page's keys, as each is on a tenth of its pages."""
    per_host = found.groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.sort_array(F.collect_list(F.when(F.col("strong"), F.col("key")))).alias("strong"))
    return rows.join(F.broadcast(per_host) if found.count() <= small else per_host, "h", "left")


def _arrays(column) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0, np.int64) for v in column]


def _batch(rows: list[tuple[int, np.ndarray]], *more: bool):
    keys = np.concatenate([k for _, k in rows]) if rows else np.empty(0, np.int64)
    hosts = np.repeat(np.array([h for h, _ in rows], np.int64), [len(k) for _, k in rows])
    return [pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(np.full(len(keys), m)) for m in more)]


def repeated_runs(parsed: DataFrame, least_pages: int, article_share: float, article_pages: int, small: int, group_words: int) -> DataFrame:
    """parsed(row, h, page, words, blocks) -> (h, key, strong): blocks and windows of LONG words that are boilerplate of their host."""
    some = parsed.where(F.size("blocks") > 0)
    # equal streams are one page
    first = some.groupBy("h", "page").agg(F.min("row").alias("row"), F.first("words").alias("words"))
    hosts = first.groupBy("h").agg(F.count(F.lit(1)).alias("host_pages"), F.sum("words").alias("host_words")).where(F.col("host_words") > group_words)
    hosts = written(hosts.select("h", "host_pages", F.ceil(F.col("host_words") / group_words).cast("int").alias("groups")), "large-hosts")
    again = written(some.select("row").join(first.select("row"), "row", "left_anti"), "again")
    pages = some.join(F.broadcast(again) if again.count() <= MANY else again, "row", "left_anti").select("h", "page", "blocks")
    # a host of one group knows its pages when they meet; only large hosts need their numbers before
    placed = pages.join(F.broadcast(hosts) if hosts.count() <= MANY else hosts, "h", "left")
    spot = F.pmod(F.xxhash64("page"), F.coalesce("groups", F.lit(1))).cast("int")
    bundled = placed.select("h", spot.alias("g"), "host_pages", "blocks").mapInArrow(bundles, "h long, g int, host_pages long, size long, pages binary")
    dealt = bundled.repartition("h", "g").sortWithinPartitions("h", "g")

    def grouped(batches):
        ids = Ids()
        held: list[tuple] = []

        def flush() -> list[tuple]:
            h, _, host_pages, _, _ = held[0]
            pages = [blocks for r in held for blocks in _unpacked(*r[3:])]
            # what a tenth of the host's pages have, a tenth of some group's pages have
            least = -(-len(pages) // 10) if host_pages else max(least_pages, -(-len(pages) // 10))
            return [(h, key, n, host_pages or len(pages), host_pages is not None) for key, n in group_keys(pages, ids, least)]

        def batch(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["h", "key", "pages", "host_pages", "open"])

        out = []
        for part in lean(batches):
            for row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[-1][:2] != row[:2]:
                    out += flush()
                    held = []
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                held.append(row)
        if held:
            out += flush()
        yield batch(out)

    def met(batches):
        ids = Ids()
        for batch in lean(batches):
            rows = []
            for h, blocks, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                if len(keys):
                    rows.append((h, covered(blocks, keys, ids)[2]))
            yield pa.RecordBatch.from_arrays(_batch(rows), ["h", "key"])

    def mostly(batches):
        ids = Ids()
        for batch in lean(batches):
            rows = []
            for h, blocks, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                if len(keys):
                    _, inside, own = covered(blocks, keys, ids)
                    if 2 * inside.sum() > len(inside):
                        rows.append((h, own))
            yield pa.RecordBatch.from_arrays(_batch(rows), ["h", "key"])

    groups = written(dealt.mapInArrow(grouped, "h long, key long, pages long, host_pages long, open boolean"), "group-runs")
    found = groups.where("NOT open").select("h", "key", "pages", "host_pages")
    opened = groups.where("open").select("h", "key", "host_pages", F.lit(False).alias("strong")).distinct()
    if not opened.isEmpty():
        opened = written(opened, "open-runs")
        wide = by_host(placed.where("groups IS NOT NULL").select("h", "blocks"), opened, small).select("h", "blocks", "keys")
        counted = wide.mapInArrow(met, "h long, key long").groupBy("h", "key").agg(F.count(F.lit(1)).alias("pages"))
        found = found.unionByName(counted.join(opened.drop("strong"), ["h", "key"]))
    strong = (F.col("pages") >= F.col("host_pages") * article_share) & (F.col("pages") >= article_pages)
    # outside containers a run on a few pages goes, but not where the host has hardly more pages than that
    found = found.where((F.col("pages") >= least_pages) & (F.col("pages") * 10 >= F.col("host_pages")))
    found = written(found.select("h", "key", "pages", strong.alias("strong")), "runs")
    copies = by_host(pages, found, small).select("h", "blocks", "keys").mapInArrow(mostly, "h long, key long").groupBy("h", "key").agg(F.count(F.lit(1)).alias("copies"))
    kept = F.coalesce(F.col("copies"), F.lit(0)) * 2 > F.col("pages")
    return written(found.join(copies, ["h", "key"], "left").where(~kept).select("h", "key", "strong"), "boilerplate")


#: Characters of text that a task bundles before it sends them on.
BUNDLE = 8 << 20


def _packed(pages: list[list[str]]) -> tuple[int, bytes]:
    """(size, compressed) of pages of blocks. No block holds the separators: they are white space, which is one space there."""
    data = "\x1e".join("\x1f".join(blocks) for blocks in pages).encode("utf-8", "surrogatepass")
    return len(data), pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _unpacked(size: int, data: bytes) -> list[list[str]]:
    text = pa.decompress(data, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass")
    return [page.split("\x1f") for page in text.split("\x1e")]


def bundles(batches):
    """Rows (h, g, host_pages, blocks) to bundles (h, g, host_pages, size, pages): a group's pages that a task meets go together,
    so that what they share is sent once."""
    held: dict[tuple, list[list[str]]] = {}
    size = 0

    def batch():
        rows = [(*key, *_packed(pages)) for key, pages in held.items()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["h", "g", "host_pages", "size", "pages"])

    for part in lean(batches):
        for h, g, host_pages, blocks in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            held.setdefault((h, g, host_pages), []).append(blocks)
            size += sum(map(len, blocks))
            if size > BUNDLE:
                yield batch()
                held, size = {}, 0
    yield batch()


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3, article_share: float = 0.5, article_pages: int = 5, small: int = 500_000, group_words: int = 250_000) -> DataFrame:
    """One row per page: id, url, text. Null or empty html: empty text. Null url: host "". Repeated rows: each its row. A page
    without article containers gives all its blocks that are no boilerplate. Equal pages of a host count once when runs are
    counted, and each gets the same text. Empty input: no rows.

    The boilerplate keys go by broadcast while they are at most `small` rows, else by a join on host. A suffix array is over
    about `group_words` words, at least a page's.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    key = p.schema["page_id"].dataType.simpleString()

    def parse(batches):
        for batch in lean(batches):
            hosts, streams, inside, found, words = [], [], [], [], []
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                c = candidates(page or "")
                found.append([s for s, _ in c])
                inside.append(any(i for _, i in c))
                words.append(sum(s.count(" ") + 1 for s in found[-1]))
                hosts.append(digest(host))
                streams.append(digest("\n".join(found[-1])))
            arrays = [pa.array(hosts, pa.int64()), pa.array(streams, pa.int64()), pa.array(words, pa.int64()), pa.array(inside, pa.bool_()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["page_id", "url", "h", "page", "words", "inside", "blocks"])

    parsed = p.mapInArrow(parse, f"page_id {key}, url string, h long, page long, words long, inside boolean, blocks array<string>")
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "blocks", "zstd")
    found = repeated_runs(parsed, least_pages, article_share, article_pages, small, group_words)

    def texts(batches):
        ids = Ids()
        for batch in lean(batches):
            out = []
            for inside, blocks, keys, strong in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), _arrays(batch.column(4)), _arrays(batch.column(5)), strict=True):
                keys = strong if inside else keys
                if len(keys) and blocks:
                    counts, gone, met = covered(blocks, keys, ids)
                    if len(met):
                        parts = np.split(~gone, np.cumsum(counts)[:-1])
                        blocks = [s if stay.all() else " ".join(w for w, k in zip(s.split(" "), stay, strict=True) if k) for s, stay in zip(blocks, parts, strict=True) if stay.any()]
                out.append("\n\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = by_host(parsed, found, small).select("page_id", "url", "inside", "blocks", "keys", "strong")
    out = joined.mapInArrow(texts, f"page_id {key}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
