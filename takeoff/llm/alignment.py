"""Alignment of two tokenizers: groups between common token ends, links of overlapping tokens, and counts of linked id pairs.

A is a byte-level BPE on a blank and the text, B a piece BPE that adds the blank itself. Byte offsets at which tokens of both end cut
the tokens into groups; tokens whose bytes overlap are linked. Within a group each stretch between two neighbouring ends is one link.

Long texts. A text over `chunk` bytes is cut into byte ranges, for A and for B each where its own rules allow it: A before a blank after
something else, or after an ASCII letter that no letter follows; B before a space after something else, as no piece of B holds
such a place. The ranges are dealt to all tasks. A range gives a fragment: an open prefix up to the first common end in it, closed
groups, and an open suffix. Two fragments compose to one: the first's suffix and the second's prefix close to groups, or stay open.
That is associative, so trees of FAN fragments a node reduce texts of any length; only open ends travel. Where no place to cut comes,
a range is longer.

Counts. Texts are taken in blocks of about BLOCK_BYTES. A block has the list of its id pairs with the number of its documents, and
documents refer to places in that list; the lists alone are summed up over the corpus and return with the totals.

Null and empty texts, and those whose tokens of A or B don't join to the blank and the text, have no tokens: zeros and an empty hash.
Repeated rows and null ids are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from takeoff.llm.common import documents, shipped, staged, text_batches

CHUNK_BYTES, BLOCK_BYTES, FAN = 1 << 16, 16 << 20, 16
PAIR_BASE = 1 << 20  # of an id pair as one number: a * PAIR_BASE + b
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Codec:
    """Both tokenizers: `a_file` a rank file, `b_file` a piece model."""

    def __init__(self, a_file: str, b_file: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_file, "rb") as f:
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for x, i in ranks.items():
            self.a_sizes[i] = len(x)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.b_blank = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") for p in pieces) or len(self.b_bytes) > PAIR_BASE:
            raise ValueError("a piece holds a blank after something else: texts can't be cut before blanks")
        n, m = len(self.a_sizes), len(self.b_bytes)
        # decimal ids with what follows them: A , or |, B , or ;
        self.shown = [f"{i}{s}".encode() for i in range(n) for s in ",|"] + [f"{i}{s}".encode() for i in range(m) for s in ",;"]

    def encode_a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode_b(self, text: str, inner: bool = False) -> list[int]:
        """`inner`: the text begins with the blank that B would add."""
        return (self.b.encode(text[1:], num_threads=1) or [self.b_blank]) if inner else self.b.encode(text, num_threads=1)

    def joins(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.b_bytes.__getitem__, ids)) == data


@functools.lru_cache(2)
def codec(a_file: str, b_file: str) -> Codec:
    return Codec(a_file, b_file)


def files() -> tuple[str, str]:
    """Of the vocabularies of the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Aligned:
    """Tokens of A and B over the same bytes: a row for each link in order, and each token's group."""

    ends: np.ndarray  # byte offset at which each link ends
    common: np.ndarray  # whether tokens of both end there
    link_a: np.ndarray  # token numbers
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    flags = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
    flags[a_ends] = 1
    flags[b_ends] |= 2
    ends = np.flatnonzero(flags)
    f = flags[ends]
    of_a, of_b, common = (f & 1).astype(bool), (f & 2).astype(bool), f == 3
    group = np.cumsum(common) - common
    return Aligned(ends, common, np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b, group[of_a], group[of_b])


def shown(c: Codec, a_ids: np.ndarray, b_ids: np.ndarray, at: Aligned) -> np.ndarray:
    """Places in `Codec.shown` of all tokens, group by group."""
    n = int(at.common.sum())
    in_a, in_b = np.bincount(at.group_a, minlength=n), np.bincount(at.group_b, minlength=n)
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    last_a, last_b = np.append(at.group_a[1:] != at.group_a[:-1], True), np.append(at.group_b[1:] != at.group_b[:-1], True)
    out[np.arange(len(a_ids)) + (np.cumsum(in_b) - in_b)[at.group_a]] = 2 * a_ids + last_a
    out[np.arange(len(b_ids)) + np.cumsum(in_a)[at.group_b]] = 2 * (len(c.a_sizes) + b_ids) + last_b
    return out


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, kind))


@dataclass
class Measured:
    """Of a list of texts: the COUNTS, hashes, and each text's id pairs (ascending) with the number of their links."""

    table: np.ndarray
    hashes: list[str]
    pair_text: np.ndarray
    pair: np.ndarray
    links: np.ndarray


def measured(c: Codec, texts: list[bytes]) -> Measured:
    table, hashes = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    held, some_a, some_b = [], [], []
    for k, data in enumerate(texts):
        if not data:
            continue
        text = data.decode("utf-8", "replace")
        b = c.encode_b(text)
        if c.joins(b, b" " + data):
            held.append(k)
            some_a.append(c.encode_a(" " + text))
            some_b.append(np.array(b, np.int64))
    if not held:
        return Measured(table, hashes, *(np.zeros(0, np.int64) for _ in range(3)))
    rows = np.array(held)
    n_a, n_b = np.array([len(x) for x in some_a]), np.array([len(x) for x in some_b])
    a, b = np.concatenate(some_a), np.concatenate(some_b)
    at = align(c.a_sizes[a], c.b_sizes[b])
    of = np.repeat(rows, n_a)[at.link_a]  # text of each link
    table[rows, 0], table[rows, 1] = n_a, n_b
    table[:, 2] = np.bincount(of[at.common], minlength=len(texts))
    table[:, 3] = np.bincount(of, minlength=len(texts))
    codes, start = shown(c, a, b, at), 0
    for k, n in zip(held, (n_a + n_b).tolist(), strict=True):
        hashes[k] = hashlib.sha256(b"".join(map(c.shown.__getitem__, codes[start : start + n].tolist()))[:-1]).hexdigest()
        start += n
    # a text's number and a pair's in one key, to sort once
    pair, links = np.unique((of << 40) | (a[at.link_a] * PAIR_BASE + b[at.link_b]), return_counts=True)
    return Measured(table, hashes, pair >> 40, pair & ((1 << 40) - 1), links)


# Short texts, in blocks


def blocks(docs: DataFrame, keep: tuple[str, ...], names: tuple[str, str]) -> DataFrame:
    """Of each text (kept columns, text): COUNTS, groups_sha256, and `items`, `links`: places in its block's pair list, with their links.

    A row without counts is the block's list: `items` its id pairs, `links` the number of documents that hold them.
    """
    shipped(docs.sparkSession)
    width = len(keep)
    schema = T.StructType([T.StructField(k, docs.schema[k].dataType) for k in keep] + T.StructType.fromDDL(f"block bigint, {', '.join(f'{x} bigint' for x in COUNTS)}, groups_sha256 string, items array<bigint>, links array<bigint>").fields)
    arrow = to_arrow_schema(schema)

    def block(number: int, kept: list[pa.RecordBatch], parts: list[Measured]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([m.table for m in parts])
        first = np.cumsum([0, *(len(m.table) for m in parts[:-1])])
        pair, link = np.concatenate([m.pair for m in parts]), np.concatenate([m.links for m in parts])
        of = np.concatenate([m.pair_text + s for m, s in zip(parts, first, strict=True)])
        names_, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        counts = np.bincount(of, minlength=len(table))
        rows = pa.Table.from_batches(kept).combine_chunks()
        columns = [pa.array(np.full(len(table), number)), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(4)), pa.array([h for m in parts for h in m.hashes], pa.string()),
                   lists(place, counts, pa.int64()), lists(link, counts, pa.int64())]
        yield from pa.Table.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns), *columns], schema=arrow).to_batches()
        one = [pa.nulls(1, f.type) for f in list(arrow)[:width]] + [pa.array([number]), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), lists(names_, np.array([len(names_)]), pa.int64()), lists(held, np.array([len(held)]), pa.int64())]
        yield pa.RecordBatch.from_arrays(one, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*names)
        number, kept, parts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for start, texts in text_batches(batch.column(width)):
                kept.append(batch.slice(start, len(texts)).select(list(range(width))))
                parts.append(measured(c, texts))
                size += sum(map(len, texts))
                if size >= BLOCK_BYTES:
                    yield from block(number, kept, parts)
                    number, kept, parts, size = number + 1, [], [], 0
        if parts:
            yield from block(number, kept, parts)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


# Long texts, in fragments


def cuts(text: str, chunk: int, inside) -> list[int]:
    """Character offsets of ranges of about `chunk` characters, cut at places where inside(before, after) holds."""
    out = [0]
    while len(text) - out[-1] > chunk:
        at = out[-1] + chunk
        while at < len(text) and not inside(text[at - 1], text[at]):
            at += 1
        if at >= len(text):
            break
        out.append(at)
    return out


def cut_a(before: str, after: str) -> bool:
    """The token pattern ends a token here whatever stands around."""
    return (after in " \n\t" and not before.isspace()) or (before.isascii() and before.isalpha() and after.isascii() and not after.isalpha())


def cut_b(before: str, after: str) -> bool:
    return after == " " and before != " " and before != "▁"


@dataclass
class Fragment:
    """Open tokens (ids and absolute ends of A and B) before and after the closed groups; not closed: all are in `before`."""

    before: list[np.ndarray]
    closed: bool
    after: list[np.ndarray]


NONE = [np.zeros(0, np.int64)] * 4  # ids and ends of A, ids and ends of B


def settle(tokens: list[np.ndarray], closed: bool) -> tuple[Fragment, list[np.ndarray]]:
    """A fragment of tokens, and those of its closed groups; `closed`: they begin at a common end."""
    a, a_ends, b, b_ends = tokens
    both = np.intersect1d(a_ends, b_ends)
    if not len(both):
        return (Fragment(NONE, True, tokens) if closed else Fragment(tokens, False, NONE)), NONE
    i, j = np.searchsorted(a_ends, both[0], "right"), np.searchsorted(b_ends, both[0], "right")
    k, m = np.searchsorted(a_ends, both[-1], "right"), np.searchsorted(b_ends, both[-1], "right")
    if closed:
        i = j = 0
    return Fragment([a[:i], a_ends[:i], b[:j], b_ends[:j]], True, [a[k:], a_ends[k:], b[m:], b_ends[m:]]), [a[i:k], a_ends[i:k], b[j:m], b_ends[j:m]]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, list[np.ndarray]]:
    """The fragment of both, and the tokens of the groups that close where they meet."""
    middle = [np.concatenate(p) for p in zip(x.after if x.closed else x.before, y.before, strict=True)]
    met, groups = settle(middle, x.closed)
    before = x.before if x.closed else met.before
    if not y.closed:
        return Fragment(before, met.closed, met.after if met.closed else NONE), groups
    # y's first common end is the last of the middle
    return Fragment(before, True, y.after), groups


FRAGMENT = "uid bigint, k bigint, closed boolean, " + ", ".join(f"{side}_{x} array<bigint>" for side in ("before", "after") for x in ("a", "a_ends", "b", "b_ends"))
GROUPS = "uid bigint, start bigint, good boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, shown binary, items array<bigint>, links array<bigint>"


def packed(uid: int, k: int, f: Fragment) -> tuple:
    return (uid, k, f.closed, *(x.tolist() for x in f.before), *(x.tolist() for x in f.after))


def grouped(c: Codec, uid: int, tokens: list[np.ndarray]) -> tuple | None:
    """A row of GROUPS for the tokens of whole groups."""
    a, a_ends, b, b_ends = tokens
    if not len(a):
        return None
    sizes_a, sizes_b = c.a_sizes[a], c.b_sizes[b]
    at = align(sizes_a, sizes_b)
    pair, links = np.unique(a[at.link_a] * PAIR_BASE + b[at.link_b], return_counts=True)
    text = b"".join(map(c.shown.__getitem__, shown(c, a, b, at).tolist()))[:-1]
    return uid, int(a_ends[0] - sizes_a[0]), True, len(a), len(b), int(at.common.sum()), len(at.ends), text, pair.tolist(), links.tolist()


KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def arrow_of(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def rows_of(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)


BOTH = f"{FRAGMENT}, g struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in GROUPS.split(', '))}>"
BOTH_ARROW = arrow_of(FRAGMENT).append(pa.field("g", pa.struct(list(arrow_of(GROUPS)))))
RANGE, HASH = "uid bigint, k bigint, a string, a_at bigint, b string, b_at bigint", "uid bigint, groups_sha256 string"


def both_kinds(fragments: list[tuple], groups: list[tuple]) -> pa.Table:
    """Rows of BOTH: a fragment, or (with a null k) groups."""
    width, names = FRAGMENT.count(",") + 1, [x.split()[0] for x in GROUPS.split(", ")]
    rows = [(*f, None) for f in fragments] + [(g[0], *[None] * (width - 1), dict(zip(names, g, strict=True))) for g in groups]
    return rows_of(rows, BOTH_ARROW)


def kept_schema(docs: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("_kept", docs.schema["_kept"].dataType)])


def ranges(docs: DataFrame, chunk: int) -> DataFrame:
    """(uid, k, texts and absolute byte offsets of A's and B's k-th range, _kept with the first) of each text; A's first begins with the added blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                for at_row, (uid, data) in enumerate(zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts, strict=True), start):
                    text, parts = data.decode("utf-8", "replace"), []
                    for inside in (cut_a, cut_b):
                        at, offset, out = [*cuts(text, chunk, inside), len(text)], 0, []
                        for i, j in zip(at, at[1:]):
                            part = text[i:j] if i or inside is cut_b else " " + text[i:j]
                            out.append((part, offset))
                            offset += len(part.encode()) + (inside is cut_b and not i)
                        parts.append(out)
                    n = max(map(len, parts))
                    a, b = (p + [("", len(data) + 1)] * (n - len(p)) for p in parts)
                    rows = [(uid, k, a[k][0], a[k][1], b[k][0], b[k][1]) for k in range(n)]
                    kept = batch.column(2).take(pa.array([at_row] + [None] * (n - 1), pa.int64()))
                    yield from rows_of(rows, arrow_of(RANGE)).append_column("_kept", kept).to_batches()

    return docs.select("uid", "text", "_kept").mapInArrow(run, kept_schema(docs, RANGE))


def fragments(parts: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows of BOTH and _kept: the fragment of each range, and its closed groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*names)
        for batch in batches:
            for r in range(batch.num_rows):
                uid, k, a_text, a_at, b_text, b_at = (batch.column(j)[r].as_py() for j in range(6))
                a = c.encode_a(a_text)
                b_list = c.encode_b(b_text, k > 0) if b_text else []
                good = not b_text or c.joins(b_list, (b_text if k else " " + b_text).encode())
                b = np.array(b_list, np.int64)
                frag, groups = settle([a, a_at + np.cumsum(c.a_sizes[a]), b, b_at + np.cumsum(c.b_sizes[b])], k == 0)
                bad = [] if good else [(uid, 0, False, 0, 0, 0, 0, b"", [], [])]
                row = grouped(c, uid, groups)
                table = both_kinds([packed(uid, k, frag)], bad + ([row] if row else []))
                kept = batch.column(6).take(pa.array([r] + [None] * (table.num_rows - 1), pa.int64()))
                yield from table.append_column("_kept", kept).to_batches()

    return parts.mapInArrow(run, kept_schema(parts, BOTH))


def reduced(found: DataFrame, names: tuple[str, str], fan: int = FAN) -> DataFrame:
    """All groups (rows of GROUPS) of texts in fragments: trees of `fan` fragments a node, a staged round a level."""
    def node(table: pa.Table) -> pa.Table:
        c, rows = codec(*names), sorted(table.to_pylist(), key=lambda r: r["k"])
        part = lambda r, side: [np.array(r[f"{side}_{x}"], np.int64) for x in ("a", "a_ends", "b", "b_ends")]
        made = [Fragment(part(r, "before"), r["closed"], part(r, "after")) for r in rows]
        one, groups = made[0], []
        for f in made[1:]:
            one, some = compose(one, f)
            row = grouped(c, rows[0]["uid"], some)
            groups += [row] if row else []
        return both_kinds([packed(rows[0]["uid"], rows[0]["k"] // fan, one)], groups)

    groups, level = found.where("k is null").select("g.*"), found.where("k is not null").drop("g", "_kept")
    most = level.agg(F.max("k")).first()[0] or 0
    while most:
        made = staged(level.groupBy("uid", F.floor(F.col("k") / fan).alias("_node")).applyInArrow(node, BOTH), "fragments")
        groups, level, most = groups.union(made.where("k is null").select("g.*")), made.where("k is not null").drop("g"), most // fan
    return groups


def hashes(groups: DataFrame) -> DataFrame:
    """(uid, groups_sha256): the texts' groups in order, hashed as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if uid != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = uid, hashlib.sha256()
                else:
                    h.update(b";")
                h.update(text.as_py())
        if h is not None:
            out.append((now, h.hexdigest()))
        yield from rows_of(out, arrow_of(HASH)).to_batches()

    dealt = groups.where("good").select("uid", "start", "shown").repartition("uid").sortWithinPartitions("uid", "start").select("uid", "shown")
    return dealt.mapInArrow(run, HASH)


# Counts over the corpus


def scored(totals: DataFrame) -> DataFrame:
    """(pair, total, best): whether the total is the highest of the pair's A id. A's vocabulary bounds the broadcast."""
    a = F.floor(F.col("pair") / PAIR_BASE)
    tops = totals.groupBy(a.alias("a")).agg(F.max("total").alias("top"))
    return totals.withColumn("a", a).join(F.broadcast(tops), "a").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def with_totals(docs: DataFrame, values: DataFrame) -> DataFrame:
    """n_best and count_sum of the documents of blocks; values: (block, pos, total, best)."""
    schema = T.StructType([f for f in docs.schema if f.name not in ("block", "items", "links")] + T.StructType.fromDDL("n_best bigint, count_sum bigint").fields)
    names = [f.name for f in schema][:-2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        total, best = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        pos = right.column("pos").to_numpy()
        total[pos], best[pos] = right.column("total").to_numpy(), right.column("best").to_numpy().astype(np.int64)
        items, links = left.column("items").combine_chunks(), left.column("links").combine_chunks()
        place, count = items.flatten().to_numpy(), links.flatten().to_numpy()
        ends = np.cumsum([len(x) for x in items])
        sums = []
        for v in (best, total):
            c = np.concatenate([[0], np.cumsum(v[place] * count)])
            sums.append(pa.array(c[ends] - np.concatenate([[0], c[ends[:-1]]]) if len(ends) else [], pa.int64()))
        return pa.table([*(left.column(x) for x in names), *sums], names=[*names, "n_best", "count_sum"])

    return docs.groupBy("block").cogroup(values.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(run, schema)


def aligned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK_BYTES, names: tuple[str, str] | None = None, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """A row per document: the kept columns, COUNTS, n_best, count_sum, groups_sha256. And the id pairs: a, b, documents that hold them linked, best."""
    names = names or files()
    rows = docs.select(F.struct(*keep).alias("_kept"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    short = staged(blocks(rows.where(~long), ("_kept",), names), "blocks")
    in_blocks, listed = short.where("n_a is not null"), short.where("n_a is null")
    entries = listed.select("block", F.posexplode(F.arrays_zip("items", "links")).alias("pos", "e")).select("block", "pos", F.col("e.items").alias("pair"), F.col("e.links").alias("docs"))

    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("uid"), "_kept", "text")
    parts = ranges(numbered, chunk).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid", "k")
    found = staged(fragments(parts, names), "ranges")
    groups = staged(reduced(found, names, fan), "groups")
    bad = groups.where("not good").select("uid").distinct()
    good = groups.where("good").join(bad, "uid", "left_anti")
    long_pairs = good.select("uid", F.explode(F.arrays_zip("items", "links")).alias("e")).groupBy("uid", F.col("e.items").alias("pair")).agg(F.sum("e.links").alias("links"))
    long_pairs = staged(long_pairs, "long_pairs")

    totals = staged(entries.groupBy("pair").agg(F.sum("docs").alias("n")).union(long_pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))).groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    marks = scored(totals)
    values = entries.join(marks, "pair").select("block", "pos", "total", "best")
    order = ["_kept", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    out = with_totals(in_blocks, values).select(*order)

    sums = good.groupBy("uid").agg(*[F.sum(x).alias(x) for x in COUNTS])
    weighed = long_pairs.join(marks, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("total")).alias("count_sum"))
    told = sums.join(weighed, "uid").join(hashes(good), "uid")
    whole = found.where("k = 0").select("uid", "_kept").join(told, "uid", "left")
    zero = [F.coalesce(x, F.lit("" if x == "groups_sha256" else 0)).alias(x) for x in order[1:]]
    result = out.union(whole.select("_kept", *zero)).select("_kept.*", *order[1:])
    pairs = marks.select(F.floor(F.col("pair") / PAIR_BASE).alias("a"), (F.col("pair") % PAIR_BASE).alias("b"), F.col("total").alias("documents"), "best")
    return result, pairs


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))[0]
