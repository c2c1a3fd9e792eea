"""Main-text extraction by templates deduced from pages of one host.

Each page is read into tokens: the paths of its elements and the texts of its blocks. A token's
occurrence vector says how often it stands on each page of the host, where pages with equal main text
count as one; grouped sums of a hash of (page, count) stand for the vectors, so that no host's pages are
ever gathered. Tokens of one host that share a vector form an equivalence class. Classes on most of the
host's pages are laid over each page, those on most pages first and texts of articles last: a class whose tokens repeat in one order
inside one gap of the classes before nests there, and its own gaps take further classes. A class is valid
if it has the same order and gap on most pages; a text whose class is not may still be so by itself.
Texts of the template are fixed; what else stands between its tokens are slots. A page's main text are
its slots inside the article (or the main element), or without either all slots that no navigation,
notice, advert, form or comment element encloses. Headings and labels of articles recur as their authors'
own words, and are never fixed. Inside an article an element's class or id says that it is apart only if it
is as a whole the name of such a part ("share-bar", not "share-price").

Edge cases: null or empty html gives an empty text; broken or unclosed markup is read as far as it
goes; pages of any length are read whole; a page without a url belongs to the host ''; a host with fewer
than three pages of different main text has no template; fixed text in an article or main element must
recur on three such pages; repeated rows give repeated results; an empty table gives an empty result; a
null page_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Pages that a host needs for a template, and the share of them on which a valid class recurs.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Hosts whose templates are broadcast, and tokens in them (eight bytes each); beyond, templates are joined by host and salt.
BROADCAST_HOSTS, BROADCAST_TOKENS, SALTS = 20_000, 1_000_000, 16
#: Token sums that a task holds before it sends them.
HELD_TOKENS = 200_000

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?][^>]*>", re.S)
_attribute = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_host = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not markup, that have no content, that start a block, and that never hold main text.
RAW = frozenset("script style noscript textarea title iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("head nav aside footer form button select option svg object canvas dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in an element's class or id by which it holds something else than main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments disqus replies respond related recommended share sharing social widget widgets search skip".split()
)
#: Words that add nothing to such a name: "share-bar" is a share bar, "share-price" is not.
GENERAL = frozenset(
    "area article articles bar block bottom box button buttons container content count footer form group header heading icon icons inline inner item items left link links list "
    "module outer panel post posts right row section slot stories story thread title toggle tools top unit wrap wrapper".split()
)
#: Words by which a class or id tells of a part of the page instead of being it.
ABOUT = frozenset("no non not has have with without".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
PLAIN = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Elements that name what follows them: in an article their text recurs as the author's own, and is never fixed.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption legend summary figcaption label".split())


def host_of(url: str | None) -> str:
    found = _host.match(url or "")
    return found[1].lower() if found else ""


def _apart(tag: str, attributes: str, inside: bool) -> int | None:
    """APART if an element holds something else than main text, NAMED if only its names say so."""
    if tag in ASIDE or tag == "header" and not inside:
        return APART
    if not attributes:
        return None
    bare = attributes.lower()
    if tag not in ("html", "body") and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", bare):
        return APART
    names: set[str] = set()
    for key, *values in _attribute.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role" and value.lower() in ROLES:
            return APART
        if key.lower() in ("class", "id"):
            for name in value.split():
                parts = {x.lower() for x in _name_parts.findall(name)}
                # Inside an article a name must as a whole be that of a notice, advert, share bar or the like.
                if not parts & ABOUT and (not inside or parts <= NAMES | GENERAL):
                    names |= parts
    if tag in PLAIN:
        return None
    if "header" in names and not inside and not names & {"entry", "post", "article", "content"}:
        return NAMED
    if names & COMMENTS:
        return APART
    return NAMED if tag != "article" and names & NAMES else None


#: Where a block stands: apart from the main text, or so by the names of an element only; anywhere else; in a main
#: element or an article inside one that is apart by name, which count where there are no others; in others.
APART, NAMED, BODY, NAMED_MAIN, NAMED_ARTICLE, MAIN, ARTICLE = range(7)


def blocks(page: str) -> Iterator[tuple[str, int, str]]:
    """(path, where, text) of each block of text in page order."""
    open_: list[tuple[str, str, int]] = []
    path, where = "", BODY
    text: list[str] = []
    end, skip = 0, len(page)

    def flush() -> Iterator[tuple[str, int, str]]:
        if text:
            clean = " ".join("".join(text).split())
            text.clear()
            if clean:
                yield path, where, clean

    def cut(depth: int) -> None:
        nonlocal path, where
        del open_[depth:]
        path, where = (open_[-1][1], open_[-1][2]) if open_ else ("", BODY)

    at = 0
    while at < skip:
        found = _markup.search(page, at)
        start = found.start() if found else skip
        if start > at:
            text.append(entities.unescape(page[at:start]))
        if not found:
            break
        at = end = found.end()
        opened, closed = found[1], found[3]
        if opened:
            tag = opened.lower()
            if tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, end) if not found[2].endswith("/") or tag in ("script", "style", "title") else None
                at = stop.end() if stop else (skip if tag in ("script", "style") else end)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCKS:
                yield from flush()
                for own in ("p", "li") if tag == "li" else ("p",):
                    depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == own or open_[i][0] in BLOCKS and open_[i][0] != own), -1)
                    if depth >= 0 and open_[depth][0] == own:
                        cut(depth)
            if tag in VOID:
                continue
            now = where
            if where != APART:
                apart = _apart(tag, found[2], where > BODY)
                named = where in (NAMED, NAMED_MAIN, NAMED_ARTICLE)
                if apart is not None:
                    now = apart
                elif tag == "article":
                    now = NAMED_ARTICLE if named else ARTICLE
                elif tag == "main" or "role" in found[2] and re.search(r"role\s*=\s*[\"']?main\b", found[2]):
                    now = max(where, NAMED_MAIN if named else MAIN)
            if now != where and (now <= NAMED or where <= NAMED):
                yield from flush()
            if tag in BLOCKS or now != where:
                path = f"{path}/{tag}"
            where = now
            open_.append((tag, path, where))
        elif closed:
            tag = closed.lower()
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), -1)
            if depth >= 0:
                if tag in BLOCKS or open_[depth][2] != (open_[depth - 1][2] if depth else BODY):
                    yield from flush()
                cut(depth)
    yield from flush()


def labelling(path: str, where: int) -> bool:
    """Whether a block is a heading or label of an article or main element."""
    return where > BODY and path.rpartition("/")[2] in LABELS


def text_token(path: str, text: str, inside: bool) -> int:
    """Token of a block's text; odd for those inside an article or main element."""
    return xxhash.xxh64_intdigest(text, seed=xxhash.xxh32_intdigest(path)) & ~1 | inside


def main_blocks(page: str) -> tuple[list[tuple[str, int, str]], int]:
    """All blocks, and where the main ones stand."""
    found = list(blocks(page))
    return found, max((where for _, where, _ in found if where > NAMED), default=BODY)


def tokens(page: str) -> tuple[int, list[int]]:
    """Hash of the main text before templates, and the page's tokens in order: 0, then each block's path and text."""
    found, top = main_blocks(page)
    content = xxhash.xxh64_intdigest("\n".join(text for _, where, text in found if where == top))
    out = [0]
    for path, where, text in found:
        out.append(xxhash.xxh64_intdigest(path) & ~1)
        if not labelling(path, where):
            out.append(text_token(path, text, where > BODY))
    return content, out


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    """The text of the page's main slots, a block to a line."""
    found, top = main_blocks(page)
    return "\n".join(text for path, where, text in found if where == top and (labelling(path, where) or text_token(path, text, where > BODY) not in template))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sequences(pages: DataFrame) -> DataFrame:
    """(host, content, tokens): the packed tokens of one page of each main text of a host."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            read = [tokens(page or "") for page in batch.column(1).to_pylist()]
            hosts = [host_of(url) for url in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([_signed(c) for c, _ in read], pa.int64()), pa.array([np.array(t, np.uint64).tobytes() for _, t in read], pa.binary())], names=["host", "content", "tokens"])

    rows = pages.select("url", "html").transform(common.in_arrow, run, "host string, content long, tokens binary")
    return rows.groupBy("host", "content").agg(F.min("tokens").alias("tokens"))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, vector, pages) of ``sequences()``: the hashed occurrence vector of each token; token 0 stands once on each page."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([_signed(k[1]) for k in sums], pa.int64()), pa.array([_signed(v[0]) for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["host", "token", "vector", "pages"])
            sums.clear()
            return rows

        for batch in batch_iter:
            for host, content, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for token, count in Counter(np.frombuffer(packed, np.uint64).tolist()).items():
                    held = sums.setdefault((host, token), [0, 0])
                    held[0] = held[0] + xxhash.xxh64_intdigest(f"{content}:{count}") & (1 << 64) - 1
                    held[1] += 1
                if len(sums) >= HELD_TOKENS:
                    yield flush()
        yield flush()

    rows = pages.select("host", "content", "tokens").transform(common.in_arrow, run, "host string, token long, vector long, pages long")
    # Vectors are sums modulo 2**64, in two halves so that no sum overflows.
    low = F.sum(F.expr("vector & 4294967295"))
    high = F.sum(F.expr("shiftrightunsigned(vector, 32)"))
    vector = F.pmod(high, F.lit(1 << 32)) * F.lit(1 << 31) + F.shiftright(F.pmod(low, F.lit(1 << 32)), 1)
    return rows.groupBy("host", "token").agg(vector.alias("vector"), F.sum("pages").alias("pages"))


def with_host(rows: DataFrame, table: DataFrame, salt: str, how: str, held: str | None = None) -> DataFrame:
    """``rows`` joined with a stored table of hosts: broadcast if its hosts and what they hold are counted small enough, else by host and salt."""
    hosts, tokens_ = table.agg(F.count("*"), F.coalesce(F.sum(F.expr(held)), F.lit(0)) if held else F.lit(0)).first()
    if hosts <= BROADCAST_HOSTS and tokens_ <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(table), "host", how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how)


def nested(page: list[int], classes: list[list[int]]) -> list[tuple[int, int]]:
    """(class or token, hash of its order and gap) of the classes, and of single texts, that stand on the page as they should.

    ``classes`` are in order of precedence. A class is told by its place there, from -1 downwards.
    """
    of = {token: i for i, c in enumerate(classes) for token in c}
    places: dict[int, list[int]] = defaultdict(list)
    for at, token in enumerate(page):
        if token in of:
            places[of[token]].append(at)
    gap = [0] * len(page)
    labels = [(-1, 0)]  # of each gap: the class, and after which of its tokens
    found = []
    for c in sorted(places):
        at, size = places[c], len(classes[c])
        order = [page[i] for i in at[:size]]
        runs = [at[i : i + size] for i in range(0, len(at), size)]
        if len(set(order)) < size or any([page[i] for i in run] != order or len({gap[i] for i in run}) > 1 for run in runs):
            continue
        inside = {labels[gap[run[0]]] for run in runs}
        if len(inside) > 1:
            continue
        found.append((-1 - c, xxhash.xxh64_intdigest(f"{inside}{order}")))
        for run in runs:
            own = gap[run[0]]
            for k, (a, b) in enumerate(zip(run, run[1:], strict=False)):
                if b > a + 1:
                    labels.append((c, k))
                    for i in range(a + 1, b):
                        if gap[i] == own:
                            gap[i] = len(labels) - 1
    singles: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for at, token in enumerate(page):
        if token in of:
            singles[token].add(labels[gap[at]])
    return found + [(token, xxhash.xxh64_intdigest(f"{inside}")) for token, inside in singles.items() if len(inside) == 1]


def classes(stored: DataFrame) -> DataFrame:
    """(host, all, classes) of stored ``occurrences()``: the host's pages, and its recurring classes by precedence, elements first."""
    hosts = common.store(stored.filter("token = 0").select("host", F.col("pages").alias("all")).filter(F.col("all") >= LEAST_PAGES), "html-hosts").read()
    # What recurs on too few pages of the smallest host goes before the join.
    likely = stored.filter(F.col("pages") >= LEAST_PAGES * LEAST_SHARE)
    recurring = with_host(likely, hosts, "token", "inner").filter(F.col("pages") >= F.col("all") * LEAST_SHARE).filter((F.col("token") % 2 == 0) | (F.col("pages") >= LEAST_PAGES))
    # Each page has few tokens, so those that recur on half of a host's pages are few as well.
    # Texts of articles are classes of their own, laid last, lest one that moves about break a class of elements.
    inside = F.pmod("token", F.lit(2)).alias("inside")
    grouped = recurring.groupBy("host", "all", "vector", inside).agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("pages").alias("pages"))
    listed = F.sort_array(F.collect_list(F.struct("inside", (-F.col("pages")).alias("less"), "vector", "tokens")))
    return grouped.groupBy("host", "all").agg(F.transform(listed, lambda x: x["tokens"]).alias("classes"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the fixed texts of each host, those of its valid nested classes."""
    read = common.store(sequences(pages), "html-tokens").read()
    known = common.store(classes(common.store(occurrences(read), "html-occurrences").read()), "html-classes").read()

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int, int, bool]] = Counter()
        given: dict[str, list[list[int]]] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), *(pa.array([k[i] for k in counts], pa.int64()) for i in (1, 2, 3)), pa.array([k[4] for k in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
                names=["host", "all", "key", "place", "single", "pages"],
            )
            counts.clear()
            return rows

        for batch in batch_iter:
            for i, (host, everywhere, packed) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if host not in given:
                    given[host] = [[x & (1 << 64) - 1 for x in c] for c in batch.column(3)[i].as_py()]
                for key, place in nested(np.frombuffer(packed, np.uint64).tolist(), given[host]):
                    counts[(host, everywhere, key if key < 0 else _signed(key), _signed(place), key >= 0)] += 1
                if len(counts) >= HELD_TOKENS:
                    yield flush()
        yield flush()

    laid = with_host(read, known, "content", "inner", "size(flatten(classes))").select("host", "all", "tokens", "classes").transform(common.in_arrow, run, "host string, all long, key long, place long, single boolean, pages long")
    agreed = laid.groupBy("host", "all", "key", "place", "single").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= F.col("all") * LEAST_SHARE)
    agreed = agreed.filter(~F.col("single") | (F.col("key") % 2 == 0) | (F.col("pages") >= LEAST_PAGES))
    valid = agreed.groupBy("host").agg(F.collect_set(F.when(F.col("single"), F.col("key"))).alias("singles"), F.collect_set(F.when(~F.col("single"), F.col("key").cast("int"))).alias("numbers"))
    members = F.flatten(F.transform("numbers", lambda x: F.get("classes", -1 - x)))
    return known.join(valid, "host").select("host", F.array_distinct(F.concat("singles", members)).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    common.tune(spark)
    source = common.spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    known = common.store(templates(source), "html-templates").read()
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), _host.pattern, 1), F.lit("")))
    joined = with_host(source.withColumn("host", host), known, "page_id", "left", "size(template)")

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = []
            known: dict[str, set[int]] = {}
            for name, page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if name not in known:
                    known[name] = {x & (1 << 64) - 1 for x in template.as_py() or ()}
                texts.append(main_text(page or "", known[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "template").transform(common.in_arrow, run, "page_id long, url string, text string, n_chars long")
