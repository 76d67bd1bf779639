"""Main text of web pages by wrappers of their hosts.

A page is a stream of text slots, each with the path of its block tags. Streams of all pages of a host are aligned one after
the other, by task and then across tasks, into a union-free regular expression: what repeats becomes a repeated group, what only some pages have an optional
one, and texts that differ a slot; texts that never differ are part of the wrapper, single ones and those of a group. Equal texts
lead the alignment, equal paths come next. A page is then read by aligning its own
stream with its host's wrapper. Slots within an article are its text, but for those whose path names other parts of a page; a
page without an article gives the slots whose text varies.

Null html: empty, no text. A page that its host's wrapper doesn't cover is judged by its own paths, slot by slot. Null url: the
empty host. Null page_ids and repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, per_text, shipped, staged

#: Characters of all wrappers up to which they are broadcast, hosts that a task holds wrappers of at a time, and groups that a host's wrappers are merged in first.
BROADCAST_CHARS, HELD_HOSTS, SALTS = 16 << 20, 500, 64
LONGEST_GROUP = 6
#: Parts of a path at either end that count, and cells of an alignment's table; longer streams are halved first.
DEEP, MOST_CELLS = 32, 4_000_000

# HTML elements whose content isn't text, that begin a new block, that have no end, and that aren't main text.
RAW = "script|style|noscript|template|textarea|select|svg|iframe|object|title|head|math|audio|video|canvas|button"
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
APART = set("nav footer aside form menu dialog fieldset header".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
APART_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|nav\w*|menu|sidebar|side|footer|header|"
                         r"breadcrumbs?|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination|pager|toc)"
                         r"(?:$|[\s_-])", re.I)
MAIN = set("article main".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:[\s=>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def element(tag: str, name: str) -> str:
    """A path's part: the tag, with the mark `!` if its attributes make it no main text, `*` if they make it main."""
    attributes = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(tag)} if " " in tag or "\n" in tag or "\t" in tag else {}
    if HIDDEN.search(tag) or any(APART_NAMES.search(attributes.get(k, "")) for k in ("class", "id", "role")):
        return f"{name}!"
    return f"{name}*" if attributes.get("role", "").lower() in ("main", "article") else name


def label(path: list[str], marks: list[tuple[int, int]]) -> tuple[str, ...]:
    """The path; of a very deep one both ends, with what its middle says about main text."""
    if len(path) <= 2 * DEEP:
        return tuple(path)
    (a, b), (c, d) = marks[DEEP], marks[len(path) - DEEP]
    return (*path[:DEEP], *["div!"] * (c > a), *["main"] * (d > b), *path[-DEEP:])


def slots(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(path, text) of each block with text, in page order; white space is one space, character references are decoded."""
    out: list[tuple[tuple[str, ...], str]] = []
    path: list[str] = []
    marks = [(0, 0)]  # up to each part of the path: those that aren't main text, and main ones
    opened: Counter[str] = Counter()
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((label(path, marks), text))

    def push(part: str) -> None:
        name = part.rstrip("!*")
        path.append(part)
        opened[name] += 1
        marks.append((marks[-1][0] + (part[-1] == "!" or name in APART), marks[-1][1] + (name in MAIN or part[-1] == "*")))

    def pop(depth: int) -> None:
        for part in path[depth:]:
            opened[part.rstrip("!*")] -= 1
        del path[depth:], marks[depth + 1 :]

    for m in TOKEN.finditer(page):
        t = m.group()
        if t[0] != "<" or t == "<":
            held.append(t)
            continue
        name = NAME.match(t)
        if t.startswith(("<!", "<?")) or m[1] or not name:
            if m[1] and m[1].lower() in ("title", "head"):
                flush()
            continue
        tag = name[1].lower()
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if t[1] == "/":
            if opened[tag]:
                pop(next(k for k in range(len(path) - 1, -1, -1) if path[k].rstrip("!*") == tag))
        else:
            if path and path[-1].rstrip("!*") == "p" or path and tag == path[-1].rstrip("!*") and tag in ("li", "td", "th", "tr", "dd", "dt"):
                pop(len(path) - 1)  # a new block ends a paragraph, and an item the one before it
            if tag != "hr" and not t.endswith("/>"):
                push(element(t, tag))
    flush()
    return out


@dataclass
class Part:
    """A slot, or a group of parts: in a wrapper, with the texts that all pages have there."""

    core: tuple  # the paths of a single occurrence
    texts: frozenset[str] = frozenset()
    optional: bool = False
    repeated: bool = False
    members: list[int] = field(default_factory=list)  # of a page: its slots
    page: str = ""  # a page that has the part
    shared: bool = False  # whether a different page has it, too

    @property
    def text(self) -> str | None:
        """The single text of a slot that is fixed."""
        return next(iter(self.texts)) if len(self.texts) == 1 and not self.repeated else None


def folded(parts: list[Part]) -> list[Part]:
    """Runs of equal neighbours become repeated groups, short ones first."""
    for size in range(1, LONGEST_GROUP + 1):
        out, i = [], 0
        while i < len(parts):
            core = tuple(p.core for p in parts[i : i + size])
            n = 1
            while tuple(p.core for p in parts[i + n * size : i + (n + 1) * size]) == core and len(core) == size:
                n += 1
            if n > 1:
                run = parts[i : i + n * size]
                out.append(Part(core[0] if size == 1 else core, frozenset().union(*(p.texts for p in run)), False, True, [m for p in run for m in p.members]))
                i += n * size
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def stream(page: list[tuple[tuple[str, ...], str]]) -> list[Part]:
    return folded([Part((path,), frozenset([text]), members=[i]) for i, (path, text) in enumerate(page)])


#: What a pair of parts counts in an alignment: equal cores, and equal cores with an equal text.
SAME_CORE, SAME_TEXT = 1, 2


def numbered(a: list[Part], b: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each part, of its core and of its core with its texts: equal ones have equal numbers; without texts there's none (-1, -2)."""
    known: dict[tuple, int] = {}
    out = []
    for parts, none in ((a, -1), (b, -2)):
        cores = [known.setdefault((p.core,), len(known)) for p in parts]
        texts = [known.setdefault((p.core, p.texts), len(known)) if p.texts else none for p in parts]
        out.append(np.array([cores, texts], np.int64).reshape(2, -1))
    return out[0], out[1]


def pair_scores(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(y[1] == v[1], SAME_TEXT, np.where(y[0] == v[0], SAME_CORE, 0)).astype(np.int32)


def table_rows(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The highest count of an alignment of each prefix of x, from the empty one, with all prefixes of y."""
    row = np.zeros(y.shape[1] + 1, np.int32)
    yield row
    for v in x.T:
        new = np.zeros_like(row)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + pair_scores(v, y)))
        row = new
        yield row


def aligned(a: list[Part], b: list[Part]) -> list[tuple[int | None, int | None]]:
    """Pairs of places in order, by a common subsequence of the parts' cores with the highest count; equal texts lead."""
    x, y = numbered(a, b)
    out: list[tuple[int | None, int | None]] = []
    todo = [(0, x.shape[1], 0, y.shape[1])]
    while todo:
        i, k, j, m = todo.pop()
        if (k - i) * (m - j) > MOST_CELLS and k - i > 1:
            half = (i + k) // 2  # where the best way crosses the middle: linear space
            *_, up = table_rows(x[:, i:half], y[:, j:m])
            *_, down = table_rows(x[:, half:k][:, ::-1], y[:, j:m][:, ::-1])
            cross = j + int((up + down[::-1]).argmax())
            todo += [(half, k, cross, m), (i, half, j, cross)]
            continue
        best = [row[::-1].tolist() for row in table_rows(x[:, i:k][:, ::-1], y[:, j:m][:, ::-1])][::-1]
        at, to = i, j
        (cores, texts), (to_cores, to_texts) = x.tolist(), y.tolist()
        while at < k or to < m:
            both = at < k and to < m
            score = (SAME_TEXT if texts[at] == to_texts[to] else SAME_CORE if cores[at] == to_cores[to] else 0) if both else 0
            if score and best[at - i][to - j] == score + best[at + 1 - i][to + 1 - j]:
                out.append((at, to))
                at, to = at + 1, to + 1
            elif to == m or at < k and best[at + 1 - i][to - j] >= best[at - i][to + 1 - j]:
                out.append((at, None))
                at += 1
            else:
                out.append((None, to))
                to += 1
    return out


def of_page(page: str) -> list[Part]:
    """The wrapper of a single page."""
    name = xxhash.xxh64_hexdigest(page.encode("utf-8", "replace"))
    return [Part(p.core, p.texts, False, p.repeated, page=name) for p in stream(slots(page))]


def merged(a: list[Part], b: list[Part]) -> list[Part]:
    """The wrapper of the pages of two wrappers."""
    out = []
    for i, j in aligned(a, b):
        if i is not None and j is not None:
            x, y = a[i], b[j]
            out.append(Part(x.core, x.texts & y.texts, x.optional or y.optional, x.repeated or y.repeated, page=x.page, shared=x.shared or y.shared or x.page != y.page))
        else:
            one = a[i] if i is not None else b[j]
            out.append(Part(one.core, one.texts, True, one.repeated, page=one.page, shared=one.shared))
    return out


def inferred(pages: list[str]) -> list[Part]:
    """The wrapper of pages of a host."""
    return functools.reduce(merged, map(of_page, pages)) if pages else []


def dumped(wrapper: list[Part]) -> str:
    return json.dumps([[p.core, sorted(p.texts), p.optional, p.repeated, p.page, p.shared] for p in wrapper])


@functools.lru_cache(4096)
def loaded(text: str) -> list[Part]:
    frozen = lambda x: tuple(map(frozen, x)) if isinstance(x, list) else x
    return [Part(frozen(core), frozenset(fixed), optional, repeated, page=page, shared=shared) for core, fixed, optional, repeated, page, shared in json.loads(text)]


def apart(path: tuple[str, ...]) -> bool:
    """Whether a path names a part of a page that isn't main text. An article's own header has its headings."""
    inside = False
    for k, e in enumerate(path):
        name = e.rstrip("!*")
        if e[-1] == "!" and name not in ("html", "body"):
            return True
        if name in APART and not (name == "header" and inside and path[-1] in HEADINGS):
            return True
        inside = inside or name in MAIN or e[-1] == "*"
    return False


def in_main(path: tuple[str, ...]) -> bool:
    return any(e.rstrip("!*") in MAIN or e[-1] == "*" for e in path)


def main_text(page: str, wrapper: list[Part]) -> str:
    found = slots(page)
    own = stream(found)
    articles = any(in_main(path) for path, _ in found)
    keep: list[int] = []
    for i, j in aligned(wrapper, own):
        if j is None:
            continue
        # fixed only if two different pages have the text: one alone may be this very page
        fixed = wrapper[i].texts if i is not None and wrapper[i].shared else ()
        for m in own[j].members:
            path = found[m][0]
            if not apart(path) and (in_main(path) if articles else found[m][1] not in fixed):
                keep.append(m)
    return "\n".join(found[m][1] for m in sorted(keep))


def wrappers_of(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages: each task merges those of its pages by host, so that only wrappers are shuffled."""
    shipped(pages.sparkSession)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Part]] = {}

        def taken() -> pa.RecordBatch:
            out = pa.record_batch({"host": pa.array(list(held), pa.string()), "wrapper": pa.array([dumped(w) for w in held.values()], pa.string())})
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column("host"), batch.column("html")):
                new, name = of_page(page.as_py()), host.as_py()
                held[name] = merged(held[name], new) if name in held else new
                if len(held) >= HELD_HOSTS:
                    yield taken()
        if held:
            yield taken()

    def merge(final: bool):
        def run(group: pa.Table) -> pa.Table:
            wrapper = functools.reduce(merged, (loaded(w) for w in sorted(group.column("wrapper").to_pylist())))
            if final:  # what only one page has is no fixed text
                wrapper = [Part(w.core, w.texts if w.shared else frozenset(), w.optional, w.repeated, shared=w.shared) for w in wrapper]
            return pa.table({"host": group.column("host")[:1], "wrapper": [dumped(wrapper)]})

        return run

    schema = "host string, wrapper string"
    some = pages.select("host", "html").mapInArrow(infer, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return some.groupBy("host", "salt").applyInArrow(merge(False), schema).groupBy("host").applyInArrow(merge(True), schema)


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and the main `text` of every page."""
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(*[F.col(k).alias(f"_{k}") for k in keep], F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    wrappers = staged(wrappers_of(rows.select("host", "html")), "wrappers")
    few = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0] <= BROADCAST_CHARS
    both = rows.join(F.broadcast(wrappers) if few else wrappers, "host", "left")
    joined = both.withColumn("text", F.concat(F.coalesce("wrapper", F.lit("[]")), F.lit("\0"), "html"))

    def measure(texts: list[bytes]) -> list:
        out = []
        for t in texts:
            wrapper, _, page = t.decode("utf-8", "replace").partition("\0")
            out.append(main_text(page, loaded(wrapper)))
        return [out]

    done = per_text(joined.withColumnRenamed("text", "_both"), measure, "text string", tuple(f"_{k}" for k in keep), "_both")
    return done.select(*[F.col(f"_{k}").alias(k) for k in keep], "text")


def op8_wrapper_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
