"""Main text of web pages by equivalence classes of same-host pages.

Every page is read into containers (elements that hold blocks, told apart by
their path of tags and class names) and text blocks (told apart by path and
text). Both are tokens. The occurrence vector of a token over the pages of its
host is kept as a hash that can be aggregated (an exclusive or of one hash for
each page and count); tokens of one host, page count and vector are an
equivalence class. Nothing of a host is gathered in one place, and a class is
no larger than a page. Accepted are classes of two tokens or more, a container
among them, on ``FEW`` pages and a ``SUPPORT``-th of the host's at least, not all
copies of one page. The page itself is a container of the class of what stands on every page.
Classes nest by the paths of their containers:

* a text block in a class with a container around it stands wherever the
  container does, as often: it is template text and is left out (unless all
  text of the page is). A page without the container does not change that;
* what is left between the tokens are the slots. The content slot is the
  outermost article or main element with at least half the host's text outside
  of boilerplate, else the outermost container; a page without it has the next
  of these containers that it holds.

Boilerplate is told by fixed lists: elements (menus, headers, footers, asides,
forms, scripts, styles ...) and class, id and role names (adverts, notices,
sidebars, comments ...). A name says nothing of an article or main element
within (but those of ``REMARKS``, which have articles of their own), nor of a container with ``DOMINANT`` of a page's text if no article or
main element is left, nor if it tells what a layout has (``has-sidebar``).
Within an article or main element the classes decide: headers and buttons are
text there, and of the names only those count that say all by themselves
(``CERTAIN``, alone or with words of ``PLACES``: ``ad-slot``, ``cookie-notice``,
``related-posts``, but not ``market-share``, ``discussion``, ``rail``, ``menu``),
nor do they count for half of the article's text and more, but for remarks. Such
a name also counts on a paragraph or list item; none counts on a heading.

A host of fewer than ``FEW`` pages uses the containers of all hosts together.
The rest of a page's content slot is its text: character references decoded,
white space in a block turned into one space, blocks joined by a line feed.

Null, empty and odd rows: a null or empty html has an empty text; a null url
belongs to the host ''; repeated rows are extracted once each; a page without
its host's content slot falls back to its first article or main element, else
to all that is not boilerplate. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices, cut_lineage

FEW = 5
SUPPORT = 4
DOMINANT = 0.75
BROADCAST_HOSTS = 50_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements by the part they play (fixed values).
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside form ul ol dl table thead tbody tfoot tr td th "
    "blockquote figure figcaption fieldset details summary dialog menu noscript template svg math select button "
    "object video audio canvas center address hgroup search".split()
)
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr option legend caption".split())
BOILERPLATE_TAGS = frozenset(
    "head nav header footer aside form menu dialog noscript template svg math select button object video audio canvas search".split()
)
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar rail widget "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus reply replies respond discussion share sharing social related recommended "
    "search toolbar pagination pager skip contentinfo complementary".split()
)
# Of these, names that hold articles of their own (remarks, teasers) and are no layout around the main one.
REMARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion "
    "comment comments disqus reply replies respond discussion related recommended".split()
)
# Names that mean boilerplate within an article, too, and words that go with them.
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup "
    "comment comments disqus respond share sharing social related recommended "
    "sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager".split()
)
PLACES = frozenset(
    "area articles bar block bottom box buttons container content form icons inline items label left links list "
    "posts right section slot stories thread tools top unit wrap wrapper".split()
)
# Blocks that are containers only where a name of CERTAIN makes them boilerplate.
ITEMS = frozenset("p li dt dd pre".split())
LAYOUT_WORDS = frozenset("has with without no not is show hide hidden".split())
MAIN = ("article", "main")


def container_name(tag: str, rest: str) -> str:
    """The tag and, if it has any, its class, id and role words without digits."""
    words = [w for m in NAMES.finditer(rest) for w in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in rest else []
    words = [w for w in words if not any(c.isdigit() for c in w)]
    return ".".join([tag, *words])


def is_named(name: str, names: frozenset = BOILERPLATE_NAMES) -> bool:
    """A class, id or role word is one of boilerplate."""
    for word in name.split(".")[1:]:
        parts = re.split(r"[-_]+", word)
        if word in names or (parts[0] not in LAYOUT_WORDS and not names.isdisjoint(parts)):
            return True
    return False


def is_certain(name: str) -> bool:
    """A class, id or role word consists of boilerplate words, a certain one among them."""
    for word in name.split(".")[1:]:
        parts = set(re.split(r"[-_]+", word))
        if not CERTAIN.isdisjoint(parts) and parts <= BOILERPLATE_NAMES | PLACES:
            return True
    return False


class Page:
    """Containers (path, boilerplate or not) and blocks (container, text)."""

    def __init__(self, html: str):
        self.paths: list[str] = []
        self.parent: list[int] = []
        self.main: list[bool] = []  # an article or main element, or within one
        self.top: list[int] = []  # the outermost article or main element around, -1 for none
        self.hard: list[bool] = []  # within an element of boilerplate
        self.named: list[bool] = []  # boilerplate by its own names
        self.remark: list[bool] = []  # within remarks or teasers
        self.own_main: list[bool] = []  # an article or main element that names around it say nothing of
        self.blocks: list[tuple[int, str]] = []
        stack = [self._open(0, "")]
        buffer: list[str] = []

        def end_block() -> None:
            if buffer:
                text = " ".join(html_lib.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        names = [""]
        at = 0
        while m := TOKEN.match(html, at):
            at = m.end()
            if (text := m["text"]) is not None:
                buffer.append(text)
                continue
            if m["cdata"] is not None:
                buffer.append(html_lib.escape(m["cdata"]))
                continue
            if m["tag"] is None:
                continue
            tag, closing = m["tag"].lower(), bool(m["close"])
            if tag in RAW:
                if not closing:  # up to its own end tag, whatever stands there
                    end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in BREAKS:
                end_block()
                if not closing and (names[-1] == "p" and tag != "br" or names[-1] == tag and tag in ITEMS):
                    stack.pop()  # its end tag was left out
                    names.pop()
            if m["rest"].endswith("/") or tag not in CONTAINERS and not (tag in ITEMS and (closing or "=" in m["rest"])):
                continue
            if not closing:
                name = container_name(tag, m["rest"])
                if tag in ITEMS and not is_certain(name):
                    continue
                names.append(tag)
                stack.append(self._open(stack[-1], name))
            elif tag in names:
                while True:
                    stack.pop()
                    if names.pop() == tag:
                        break
        end_block()
        size = [0] * len(self.paths)
        for at, text in self.blocks:
            size[at] += 0 if self.hard[at] else len(text)
        for at in range(len(size) - 1, 0, -1):
            size[self.parent[at]] += size[at]
        for at, top in enumerate(self.top):
            if self.named[at] and top >= 0 and not self.remark[at] and size[at] and 2 * size[at] >= size[top]:
                self.named[at] = False
        self.noise = self._noise()
        if not any(m and n and not noisy for m, n, noisy in zip(self.main, size, self.noise)):
            dominant = [at for at, n in enumerate(size) if self.named[at] and n and n >= DOMINANT * size[0]]
            for at in dominant:
                self.named[at] = False
            self.noise = self._noise() if dominant else self.noise

    def _open(self, parent: int, name: str) -> int:
        tag = name.split(".")[0]
        first = not self.paths
        above, hard, main = ("", False, False) if first else (self.paths[parent], self.hard[parent], self.main[parent])
        remark = not first and self.remark[parent]
        named = tag not in ("html", "body") and (is_certain(name) if main or tag in ITEMS else is_named(name))
        self.paths.append(f"{above}/{name}" if above else name)
        self.parent.append(parent)
        self.main.append(main or tag in MAIN)
        self.top.append((self.top[parent] if self.top[parent] >= 0 else parent) if main else -1)
        self.hard.append(hard or (tag in BOILERPLATE_TAGS and not (main and tag in ("header", "button"))))
        self.named.append(named and tag not in MAIN)
        self.remark.append(remark or (named and is_named(name, REMARKS)))
        self.own_main.append(tag in MAIN and not main and not named and not remark)
        return len(self.paths) - 1

    def _noise(self) -> list[bool]:
        noise: list[bool] = []
        for at, above in enumerate(self.parent):
            around = at > 0 and noise[above] and not self.own_main[at]
            noise.append(self.hard[at] or self.named[at] or around)
        return noise


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def token_hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), 17) - (1 << 63)


SPINE = "/"


def page_tokens(page: Page, key: int) -> Iterator[tuple[str, int | None, int, int]]:
    """(path, hash of a text block or None for a container, vector share,
    characters inside) of a page; the page itself is the container "/"."""
    yield SPINE, None, token_hash(key, 1), 0
    inside: Counter[str] = Counter()
    for at, text in page.blocks:
        if not page.noise[at]:
            path = page.paths[at]
            while path:
                inside[path] += len(text)
                path = path.rpartition("/")[0]
    for path, n in Counter(p for p, noisy in zip(page.paths, page.noise) if not noisy and p).items():
        yield path, None, token_hash(key, n), inside[path]
    for (path, text), n in Counter((page.paths[at], text) for at, text in page.blocks if not page.noise[at]).items():
        yield path, token_hash(path, text), token_hash(key, n), 0


def tokens(pages: DataFrame) -> DataFrame:
    """host, path, block, n_pages, vector, chars and the lowest and highest hash
    of a page's html, summed up for each batch; containers also under the host
    of all pages, null."""
    names = ["host", "path", "block", "n_pages", "vector", "chars", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "html"):
                seen: dict[tuple, list[int]] = {}
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    html = html or ""
                    content = token_hash(html)
                    key, host = token_hash(page_id, url, content), host_of(url)
                    for path, block, share, chars in page_tokens(Page(html), key):
                        for of in (host, None) if block is None else (host,):
                            have = seen.setdefault((of, path, block), [0, 0, 0, content, content])
                            have[0] += 1
                            have[1] ^= share
                            have[2] += chars
                            have[3] = min(have[3], content)
                            have[4] = max(have[4], content)
                columns = list(zip(*((*k, *v) for k, v in seen.items()))) or [()] * 8
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "host string, path string, block long, n_pages long, vector long, chars long, low long, high long"
    return pages.mapInArrow(run, schema).groupBy("host", "path", "block").agg(
        F.sum("n_pages").alias("n_pages"),
        F.bit_xor("vector").alias("vector"),
        F.sum("chars").alias("chars"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """host, slots (paths of containers, the first that a page holds is its
    content slot), pages and constant (hashes of the text blocks that belong to
    the template); the null host is for all pages."""
    found = cut_lineage(tokens(pages).where(F.col("block").isNull() | (F.col("n_pages") >= FEW)))
    total = found.where((F.col("path") == SPINE) & F.col("block").isNull()).select(F.col("host").alias("h"), F.col("n_pages").alias("pages"))
    met = found.join(total, F.col("host").eqNullSafe(F.col("h"))).where(SUPPORT * F.col("n_pages") >= F.col("pages"))
    boxes = met.where(F.col("block").isNull() & (F.col("path") != SPINE) & (F.col("chars") > 0))
    most = boxes.groupBy(F.col("h").alias("m")).agg(F.max("chars").alias("most"))
    steps = F.split("path", "/")
    is_main = F.split(F.element_at(steps, -1), r"\.")[0].isin(*MAIN)
    slots = (
        boxes.join(most, F.col("h").eqNullSafe(F.col("m")))
        .where(2 * F.col("chars") >= F.col("most"))
        .groupBy("h")
        .agg(F.sort_array(F.collect_list(F.struct((~is_main).alias("other"), F.size(steps).alias("depth"), "path"))).alias("slots"), F.max("pages").alias("pages"))
        .select("h", "pages", F.col("slots.path").alias("slots"))
    )
    classes = (
        met.where(F.col("host").isNotNull() & (F.col("n_pages") >= FEW) & (F.col("low") < F.col("high")))
        .groupBy("h", "n_pages", "vector")
        .agg(
            F.collect_list(F.when(F.col("block").isNull(), F.col("path"))).alias("boxes"),
            F.collect_list(F.when(F.col("block").isNotNull(), F.struct("path", "block"))).alias("blocks"),
        )
        .where((F.size("boxes") > 0) & (F.size("blocks") > 0))
    )
    around = F.exists("boxes", lambda b: (b == SPINE) | F.startswith(F.concat(F.col("b.path"), F.lit("/")), F.concat(b, F.lit("/"))))
    constant = (
        classes.select("h", "boxes", F.explode("blocks").alias("b")).where(around).groupBy(F.col("h").alias("c")).agg(F.collect_list("b.block").alias("constant"))
    )
    return cut_lineage(
        slots.join(constant, F.col("h").eqNullSafe(F.col("c")), "left").select(F.col("h").alias("host"), "slots", "pages", "constant")
    )


def main_text(html: str, slots, constant) -> str:
    """The blocks of the content slot, those of the template left out."""
    page = Page(html)
    own = [(page.paths[at], text) for at, text in page.blocks if not page.noise[at]]
    for slot in slots or ():
        if inside := [(p, t) for p, t in own if p == slot or p.startswith(slot + "/")]:
            break
    else:
        main = next((p for p, n in zip(page.paths, page.noise) if not n and p.rpartition("/")[2].split(".")[0] in MAIN), "")
        inside = [(p, t) for p, t in own if not main or p == main or p.startswith(main + "/")]
    texts = [t for _, t in inside]
    if constant:
        known = set(constant)
        texts = [t for p, t in inside if token_hash(p, t) not in known] or texts
    return "\n".join(texts)


def _host(url: Column) -> Column:
    """:func:`host_of` as a column."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    found = templates(rows)
    common = found.where("host is null").first()  # one row: the slot of all pages together
    common_slots = common["slots"] if common else None
    hosts = found.where("host is not null").where(F.col("pages") >= FEW).select("host", "slots", "constant")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    met = rows.withColumn("host", _host(F.col("url"))).join(hosts, "host", "left").select("page_id", "url", "html", "slots", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "html"):
                texts = [
                    main_text(html or "", slots or common_slots, constant)
                    for html, slots, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "constant")))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
