"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id. A longer one than a sequence is cut so that only its first piece is shorter.
A full piece is a sequence of its own and takes part in nothing else. The others are dealt to groups by a hash; each group places its pieces one by one: into the open sequence, or a new one, that
makes the sum over all residual gaps of (open sequences with that gap) squared smallest. A group needs a count for each gap
and no texts. Groups grow in number with the data, and a group leaves few sequences open, so the loss is a few sequences a
group of `group_pieces` pieces.

Null text: empty, one piece of the end id alone. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, per_text, shipped, staged

CAPACITY = 2048
GROUP_PIECES = 200_000
#: A longer text is encoded in parts cut before a blank, where the token pattern always cuts, too.
ENCODE_CHARS = 1 << 16


@functools.lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a rank file; the same vocabulary, pattern, added tokens and ids as its tokenizers file, at four times the speed."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the tokenizers file beside a rank file."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, path: str) -> np.ndarray:
    """Token ids and the end id 0, as unsigned 32-bit numbers."""
    encode = functools.partial(encoder(path).encode, allowed_special="all")
    parts, start = [], 0
    while len(text) - start > ENCODE_CHARS:
        # a single space between two letters: the pattern starts a token there whatever stands around it, and no added token has one inside
        cut = start + ENCODE_CHARS
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        parts.append(encode(text[start:cut]))
        start = cut
    parts.append(encode(text[start:]))
    return np.array([i for p in parts for i in p] + [0], "<u4")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: full ones but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, n_ids, pieces: array of start, length and crc32 of its ids); a document keeps one row."""
    def measure(texts: list[bytes]) -> list:
        out = []
        for t in texts:
            ids = token_ids(t.decode("utf-8", "replace"), path or rank_file())
            out.append([(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in pieces_of(len(ids), capacity)])
        return [out]

    return per_text(docs, measure, "pieces array<struct<start: bigint, length: bigint, ids_crc32: bigint>>")


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset for each size, in the order given, by the least growth of the sum of squares; ties go to the smallest gap left."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gap 0 isn't open and stays 0
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        left = capacity - s  # of a new sequence
        # from gap s + r to gap r: the squares grow by 2 (N[r] - N[s + r] + 1), and by 1 - 2 N[s] where the gap closes
        growth = 2 * (counts[:left] - counts[s:capacity] + 1)
        if left:
            growth[0] -= 1
            growth[counts[s:capacity] == 0] = never
            r = int(growth.argmin())
        if left and growth[r] <= 2 * counts[left] + 1:
            b = held[r + s].pop()
            counts[r + s] -= 1
        else:
            r, b, made = left, made, made + 1
        bins[i], offsets[i] = b, capacity - r - s
        if r:
            counts[r] += 1
            held[r].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of 1 to `capacity`; reads them three times, so pass a staged table.

    Full pieces get negative numbers where they are read, without a shuffle; only shorter ones fill groups.
    """
    shipped(pieces.sparkSession)
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            group = table.column("_group")[0].as_py()
            bins, offsets = place(table.column("length").to_numpy(), capacity)
            ids = pa.array(group + groups * bins)
            yield from table.drop_columns(["_group"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets)).to_batches()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups of a partition that is sorted by group."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                g = batch.column("_group").to_numpy()
                if held and held[-1].column("_group")[0].as_py() != g[0]:
                    yield pa.Table.from_batches(held)
                    held = []
                n = int(np.searchsorted(g, g[0], "right"))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield pa.Table.from_batches(held)

    salted = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    dealt = salted.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, alone.schema).unionByName(alone)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised(docs, path, capacity).select("doc_id", F.posexplode("pieces").alias("piece", "p")).select(
        "doc_id", "piece", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.ids_crc32").alias("ids_crc32"))
    return pack(staged(pieces, "pieces"), capacity, group_pieces)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
