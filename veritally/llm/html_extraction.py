"""Main text of web pages, by host suffix arrays with the pages' elements as evidence.

Parsing drops what elements, roles and class names say is no content: menus, headers, footers, sidebars, notices, adverts, forms,
comments. What is left are blocks, and whether a main or article element vouches for them. Then the token streams of all pages of a host
are concatenated and their suffix array tells on how many distinct pages each run of LEAST tokens stands; pages with the same
blocks (repeated rows, mirrors) are one page here.

* On pages that nothing vouches for, runs that stand on SEVERAL pages (of a host of two: on both) are removed, and other runs are kept.
* Blocks that an element vouches for are removed only whole, and only where all their tokens lie in runs that stand on half of the host's
  pages and on SURE of them at least: an article may quote another, but doesn't stand on every other page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Tokens of a boilerplate run at least; distinct pages of a host that it stands on at least (2 where the host has only 2), and
#: where an element vouches for it; pages of a host that one suffix array spans, about; rows of a host from which it is dealt over several tasks.
LEAST, SEVERAL, SURE, BUNDLE, HOT = 8, 3, 8, 256, 4096
#: How many times as many words must stand outside the articles for them not to be the page's text.
TEASER = 10
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*>", re.S
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(\bhidden\b)", re.S)
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_DROPPED = frozenset("nav footer aside form menu dialog button select svg object audio video canvas head label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs topbar masthead header footer copyright sidebar aside widget cookie cookies consent gdpr "
    "notice popup modal banner alert ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion newsletter subscribe "
    "signup login search comment comments disqus respond replies".split()
)
#: Of these, names of what is never around a page's content.
_NEVER = frozenset("ad ads adv advert adverts advertisement adsense adslot sponsor sponsored comment comments disqus respond replies".split())
_NAMED = re.compile(
    r"(?:(?:site|global|top|main|primary|secondary|left|right|mobile|footer)[-_])?(?:nav|navbar|navigation|menu|sidebar|footer|breadcrumbs?)|nav[-_](?:bar|menu|links|list)|"
    r"(?:site|global|top)[-_]header|(?:cookies?|consent|gdpr)[-_](?:banner|notice|bar|popup|modal|consent)|(?:newsletter|subscribe|signup|login|search)[-_](?:form|box|popup|modal)"
)
_NEVER_NAMED = re.compile(r"(?:ads?|advert|sponsor)[-_](?:slot|unit|banner|box|container|wrapper|block|\d+)|comments?[-_](?:list|section|area|form|respond|\d+)")
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _dropped(name: str, attrs: str) -> str:
    """"always" or "class" where an element isn't content, the latter where its class or id says so but it may be around a page's content.

    A class or id counts by its whole name or by known patterns: parts of names (no-sidebar, comments-open, entry-header) say nothing.
    """
    if name in _DROPPED:
        return "always"
    out = ""
    if "=" in attrs or "hidden" in attrs:
        for key, a, b, c, hidden in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if hidden or key == "role" and value in _ROLES or key == "style" and "display:none" in value.replace(" ", ""):
                return "always"
            if key in ("class", "id") and name not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
                for x in value.split():
                    if x in _NEVER or _NEVER_NAMED.fullmatch(x):
                        return "always"
                    if name != "article" and (x in _WORDS or _NAMED.fullmatch(x)):
                        out = "class"
    return out


def _main(attrs: str) -> bool:
    """Whether the attributes give the role main, however it is written."""
    return "role" in attrs.lower() and any(key.lower() == "role" and "main" in (a or b or c).lower().split() for key, a, b, c, _ in _ATTR.findall(attrs))


def parse(page: str, keep: frozenset[int] = frozenset()) -> tuple[list[tuple[str, str]], frozenset[int]]:
    """(kind, text) of each block in page order, and where elements start that only their class drops though they are around an article or main.

    Kind is article, main, both (an article in a main element, or the other way round) or open. What is dropped isn't returned; elements that start at `keep` aren't dropped by class.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, str, tuple | None]] = []  # name, dropped, kind, starts of what drops by class (None: always dropped): as they hold inside the element
    said: list[str] = []
    around: set[int] = set()
    dropped, kind, at, by = False, "open", 0, ()

    def say(text: str) -> None:
        # references are read before texts are joined over tags
        if not dropped and text:
            said.append(html.unescape(text) if "&" in text else text)

    def close() -> None:
        if said:
            if text := " ".join("".join(said).split()):
                out.append((kind, text))
            said.clear()

    def pop(k: int) -> None:
        nonlocal dropped, kind, by
        if any(x[0] in _BLOCK for x in stack[k:]):
            close()
        del stack[k:]
        _, dropped, kind, by = stack[-1] if stack else ("", False, "open", ())

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK or name != "article" and name != "main" and name != "body" and name != "html" and stack[k][0] in ("article", "main") and name in ("p", "li", "td", "tr"):
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in _CLOSES.get(name, ()):
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
            close()
        if name == "br" or name == "hr":
            say(" ")
            continue
        if name in _VOID or m["attrs"].endswith("/") and name not in _BLOCK:
            continue
        gone = "always" if by is None else _dropped(name, m["attrs"])
        if name == "header" and not gone and not by and kind == "open":
            gone = "always"
        own = "article" if name == "article" else "main" if name == "main" or _main(m["attrs"]) else ""
        role = "both" if own and kind not in ("open", own) else own or kind
        inner = None if gone == "always" else (*by, m.start()) if gone and m.start() not in keep else by
        if inner and own:
            around.update(inner)
        stack.append((name, inner != (), role, inner))
        _, dropped, kind, by = stack[-1]
    say(page[at:])
    close()
    return out, frozenset(around)


def _words(found: list[tuple[str, str]], kinds: tuple[str, ...]) -> int:
    return sum(len(t.split()) for k, t in found if k in kinds)


def settled(page: str | None) -> tuple[bool, list[str]]:
    """Whether an element vouches for the page's blocks, and they.

    A main element with words holds the text: all of it, or the articles in it unless they are teasers. Without one the articles are the text,
    unless they are teasers, which have less than a TEASER-th of the words beside them.
    """
    found, around = parse(page or "")
    if around and all(k == "open" for k, _ in found):
        # the only article stands in what its class drops: that stays, beside what else the page has
        whole, _ = parse(page or "", around)
        found = [("open", t) for _, t in whole] if found else whole
    inner, main, article, other = (_words(found, (k,)) for k in ("both", "main", "article", "open"))
    if inner + main:
        kinds = ("both",) if TEASER * inner >= main and inner else ("both", "main")
    else:
        kinds = ("article",) if article and TEASER * article >= other else ()
    return bool(kinds), [t for k, t in found if not kinds or k in kinds]


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes by their first `length` tokens, by prefix doubling: suffixes with equal ranks share them."""
    rank, done = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while done < length:
        step = min(done, length - done)
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank, done = np.unique((rank << 32) + after + 1, return_inverse=True)[1].astype(np.int64), done + step
    return rank


class Runs:
    """The token streams of pages, given as blocks, and the class of each token's run of `least` tokens in their suffix array."""

    def __init__(self, pages: list[list[str]], least: int = LEAST) -> None:
        numbers: dict[str, int] = {}
        stream: list[int] = []
        of: list[int] = []
        for k, page in enumerate(pages):
            for text in page:
                ids = [numbers.setdefault(w, len(numbers)) for w in text.split()]
                stream += ids
                of += [k] * len(ids)
            stream.append(-1 - k)  # no run goes past a page
            of.append(k)
        self.pages, self.least, self.words, self.stream, self.of = pages, least, list(numbers), np.array(stream, np.int64), np.array(of, np.int64)
        self.rank = suffix_ranks(self.stream, least)
        self.first = np.unique(self.rank, return_index=True)[1]
        ends = np.flatnonzero(self.stream < 0)
        #: whether a class is a whole run, none that a page's end cuts
        self.whole = ends[np.searchsorted(ends, self.first)] - self.first >= least

    def counts(self, among: np.ndarray | None = None) -> np.ndarray:
        """Pages on which each class stands, of those that `among` is true for."""
        use = slice(None) if among is None else among[self.of]
        return np.bincount(np.unique((self.rank[use] << 32) + self.of[use]) >> 32, minlength=len(self.first))

    def names(self, host: str, chosen: np.ndarray) -> np.ndarray:
        """128 bits for the run of each chosen class, the same wherever it stands on the host's pages."""
        import xxhash

        at, out = self.first[chosen], []
        used = np.unique(self.stream[at[:, None] + np.arange(self.least)]) if len(at) else np.zeros(0, np.int64)
        for seed in (1, 2):
            of = np.zeros(max(1, len(self.words)), np.uint64)
            of[used] = [xxhash.xxh3_64_intdigest(self.words[i], seed) for i in used.tolist()]
            mixed = np.full(len(at), xxhash.xxh3_64_intdigest(host, seed), np.uint64)
            for j in range(self.least):
                mixed = (mixed ^ of[self.stream[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            out.append(mixed.view(np.int64))
        return np.stack(out, axis=1)

    def without(self, common: np.ndarray, whole: np.ndarray | None = None) -> list[list[str]]:
        """Of each page's blocks, what no run of a common class covers; on pages that `whole` is true for, the blocks that aren't covered entirely.

        common has a truth for each class, and where whole is given one row for other pages and one for those.
        """
        whole = np.zeros(len(self.pages), bool) if whole is None else whole
        rows = common if common.ndim == 2 else common[None]
        covered = []
        for row in rows:
            starts, shared = np.flatnonzero((row & self.whole)[self.rank]), np.zeros(len(self.stream) + 1, np.int64)
            np.add.at(shared, starts, 1)
            np.add.at(shared, starts + self.least, -1)
            covered.append(np.cumsum(shared) > 0)
        at, out = 0, []
        for page, entire in zip(self.pages, whole.tolist(), strict=True):
            kept, cover = [], covered[-1 if entire else 0]
            for text in page:
                words = text.split()
                over = cover[at : at + len(words)]
                if entire or not over.any():
                    kept += [] if over.all() else [text]  # one without words too
                elif left := [w for w, c in zip(words, over, strict=True) if not c]:
                    kept.append(" ".join(left))
                at += len(words)
            at += 1
            out.append(kept)
        return out


def unique_runs(pages: list[list[str]], least: int = LEAST, several: int = 2) -> list[list[str]]:
    """Of each page's blocks, what isn't covered by a run of `least` tokens or more that stands on `several` pages or more."""
    runs = Runs(pages, least)
    return runs.without(runs.counts() >= several)


_BUNDLES = "host string, bundle long, keys array<string>, sure array<boolean>, sizes array<long>, blocks binary, page_ids array<{kind}>, urls array<string>, of array<string>"


def _shut(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(text, asbytes=True)


def _opened(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b""


def _pages(sizes: list[int], blob: bytes) -> list[list[str]]:
    """The blocks of each page of a bundle."""
    text, ends = _opened(blob), np.cumsum([0, *sizes]).tolist()
    return [text[a:b].decode().split("\n") if b > a else [] for a, b in zip(ends, ends[1:], strict=False)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row; text is empty where a page has none.

    Null html counts as empty; a null url is a host of its own; repeated rows are returned each, with the same text; an empty table
    gives no rows; other columns are ignored. Each page is parsed once, where it is read; its blocks go to its
    host, those of hosts of more than HOT rows to one of several shares of it, and are dealt over bundles of about BUNDLE pages there, so that a host of any size is many small groups, and a bundle is written as one row. Bundles count their runs and the counts
    are added up over the host: exactly on pages that no element vouches for. On the others a bundle reports what stands on a quarter
    of its pages, since a run that stands on half of a host's pages is that frequent in every bundle of about 256 pages (by chance rarer with
    a probability of 1e-15). Runs of different bundles are the same where 128 bits of hash are.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [settled(x) for x in batch.column(2).to_pylist()]
            keys = [hashlib.md5("\n".join([str(sure), *own]).encode()).hexdigest() for sure, own in found]
            columns = [pa.array(keys), pa.array([sure for sure, _ in found], pa.bool_()), pa.array([_shut("\n".join(own).encode()) for _, own in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "key", "sure", "blob"])

    def bundled(key: tuple, rows: pa.Table) -> pa.Table:
        first = dict(zip(rows["key"].to_pylist()[::-1], range(rows.num_rows - 1, -1, -1), strict=True))
        many, out = -(-len(first) // BUNDLE), []
        of = np.array([int(k[:15], 16) % many for k in rows["key"].to_pylist()])
        for bundle in range(many):
            own = rows.filter(pa.array(of == bundle))
            keys = sorted(k for k in first if int(k[:15], 16) % many == bundle)
            kept = rows.take(pa.array([first[k] for k in keys], pa.int64()))
            texts = [_opened(x) for x in kept["blob"].to_pylist()]
            lists = {"keys": pa.array(keys, pa.string()), "sure": kept["sure"], "sizes": pa.array(list(map(len, texts)), pa.int64()), "page_ids": own["page_id"], "urls": own["url"], "of": own["key"]}
            columns = {n: pa.array([x.to_pylist()], pa.list_(x.type)) for n, x in lists.items()}
            name = pa.array([key[1].as_py() << 20 | bundle], pa.int64())
            out.append(pa.table({"host": pa.array([key[0].as_py()], pa.string()), "bundle": name, **columns, "blocks": pa.array([_shut(b"".join(texts))], pa.binary())}))
        return pa.concat_tables(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["host", "bundle", "pages", "sure", "sizes", "blocks"]).to_pylist():
                runs, sure = Runs(_pages(r["sizes"], r["blocks"])), np.array(r["sure"], bool)
                for vouched, least in ((False, 1), (True, max(1, min(SURE, int(sure.sum())) / 4, sure.sum() / 4))):
                    if not (sure == vouched).any() or vouched and r["pages"] < SURE:
                        continue
                    n = runs.counts(sure == vouched)
                    chosen = np.flatnonzero(runs.whole & (n >= least))
                    names = runs.names(r["host"], chosen)
                    told = [pa.array([r[x]] * len(chosen), t) for x, t in (("host", pa.string()), ("bundle", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*told, pa.array([vouched] * len(chosen), pa.bool_()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(n[chosen])], ["host", "bundle", "vouched", "a", "b", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                pages = _pages(r["sizes"], r["blocks"])
                if r["marks"]:
                    runs = Runs(pages)
                    names = np.ascontiguousarray(runs.names(r["host"], np.flatnonzero(runs.whole))).view(pair).ravel()
                    common = np.zeros((2, len(runs.first)), bool)
                    for vouched in (False, True):
                        seen = np.array([(m["a"], m["b"]) for m in r["marks"] if m["vouched"] == vouched], pair)
                        common[int(vouched), runs.whole] = np.isin(names, seen)
                    pages = runs.without(common, np.array(r["sure"], bool))
                text = dict(zip(r["keys"], map("\n".join, pages), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("page_ids").slice(k, 1).flatten(), batch.column("urls").slice(k, 1).flatten(), pa.array([text[x] for x in r["of"]], pa.string())], ["page_id", "url", "text"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host")
    rows = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host)
    # one host in HOT rows at most, so this is small beside the pages
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("host").alias("named"), F.ceil(F.col("n") * 2 / HOT).alias("shares"))
    told = rows.mapInArrow(parsed, f"page_id {kind}, url string, host string, key string, sure boolean, blob binary")
    dealt = told.join(F.broadcast(hot), F.col("host") == F.col("named"), "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("key"), F.col("shares")), F.lit(0).cast("long")))
    packed = stash(dealt.select("host", "share", "key", "sure", "blob", "page_id", "url").groupBy("host", "share").applyInArrow(bundled, _BUNDLES.format(kind=kind)))
    # distinct pages of a host: equal ones share a bundle
    sizes = packed.groupBy("host").agg(*(F.sum(F.size((F.filter("sure", lambda x: x) if v else F.filter("sure", lambda x: ~x)))).alias(n) for n, v in (("plain", False), ("pages", True)))).withColumnRenamed("host", "named")
    sized = packed.join(sizes, F.col("host") == F.col("named")).drop("named")
    counted = stash(sized.select("host", "bundle", "pages", "sure", "sizes", "blocks").mapInArrow(count, "host string, bundle long, vouched boolean, a long, b long, n long"))
    # a run of the whole host has a row for each bundle at most, so none is hot
    common = counted.groupBy("vouched", "a", "b").agg(F.sum("n").alias("all"), F.first("host").alias("named")).join(sizes, "named")
    enough = F.when(F.col("vouched"), F.greatest(F.lit(SURE), F.col("pages") / 2)).otherwise(F.greatest(F.lit(2), F.least(F.lit(SEVERAL), "plain")))
    common = common.where(F.col("all") >= enough).select("vouched", "a", "b")
    marks = counted.join(common, ["vouched", "a", "b"]).groupBy(F.col("host").alias("on"), F.col("bundle").alias("at")).agg(F.collect_list(F.struct("vouched", "a", "b")).alias("marks"))
    cuts = packed.join(marks, (F.col("host") == F.col("on")) & (F.col("bundle") == F.col("at")), "left").drop("on", "at")
    return cuts.mapInArrow(cut, f"page_id {kind}, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_html": op5_html}
ORACLE_SQL: dict[str, str] = {}
