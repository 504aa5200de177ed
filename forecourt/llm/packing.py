"""Best-fit packing of token pieces by exact-complement hashing.

The packing itself works on the histogram of piece lengths (at most `capacity` counts), which is the only
thing that reaches the driver. Lengths are taken from the longest down. The gap that a piece leaves is
looked up among single, pair and triple length sums; a combination that fills it exactly is used as many
times as all its lengths are available. Of several combinations the one whose shortest length is longest is taken,
so that short pieces stay for the end. What has no exact complement takes, in the same pass, the largest sum of up to
three lengths that its gap holds. (Exact gaps ahead of all others would use up the short lengths that the rest needs.) Plain
best-fit is kept for histograms on which it needs fewer sequences. The result is a short list of patterns with
multiplicities; a piece finds its place from its length and its rank among the pieces of that length.

Ranks need no group of all pieces of one length: pieces are spread over buckets within each length, and a
bucket's ranks begin after the counts of the buckets before it.

Defined cases: a null text counts as empty, so its document is the single end id; rows that repeat are packed
as often as they occur; pieces of equal length are interchangeable, and which of them goes where follows from a hash;
texts of any length are cut into pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, materialize, table

CAPACITY = 2048

def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def make_encoder(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={"<|endoftext|>": 50256})


def tokenize_pieces(
    docs: DataFrame, ranks: bytes, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, salt, and with keep_ids the ids themselves.

    A document is its ids and end_id. Longer ones than capacity are cut into full pieces from the end, so that
    only the first piece may be shorter. salt tells repeated rows of one task apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder(*shared.value)
        salt = 0
        for batch in batches:
            ids, pieces, starts, lengths, crcs, salts, kept, texts = [], [], [], [], [], [], [], batch.column(1)
            for key, text in zip(batch.column(0), texts.to_pylist(), strict=True):
                tokens = np.append(encoder.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(end_id)).astype("<u4")
                n, at, k = len(tokens), 0, 0
                step = n % capacity or capacity
                while at < n:
                    part = tokens[at : at + step]
                    ids.append(key.as_py())
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    salts.append(salt)
                    if keep_ids:
                        kept.append(part.astype(np.int32))
                    at, k, step, salt = at + step, k + 1, capacity, salt + 1
            columns = [pa.array(ids, batch.schema.field(0).type), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, salts))]
            names = [id_col, "piece", "start", "length", "ids_crc32", "salt"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs.select(id_col, text_col), run, schema)


class Sums:
    """Available piece lengths with their counts, and the sums of one, two and three of them as bit sets."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.free[length] = n
        self.all_bits = (1 << capacity + 1) - 1
        self.known: bytes = b""

    def index(self) -> None:
        """Brings the sums up to date with which lengths are available."""
        have = (self.free > 0).tobytes()
        if have == self.known:
            return
        self.known, lengths = have, np.flatnonzero(self.free).tolist()
        self.singles, self.pairs, self.triples = sum(1 << x for x in lengths), 0, 0
        for x in lengths:
            self.pairs |= self.singles << x
        self.pairs &= self.all_bits
        for x in lengths:
            self.triples |= self.pairs << x
        self.triples &= self.all_bits

    def add(self, need: dict[int, int], times: int) -> None:
        for x, k in need.items():
            self.free[x] += times * k

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths that sum to gap: as few as do, and of pairs and triples the one whose least is longest."""
        self.index()
        free, have = self.free, self.free > 0
        if self.singles >> gap & 1:
            return (gap,)
        if self.pairs >> gap & 1:
            b = np.arange((gap + 1) // 2, gap)
            b = b[have[b] & have[gap - b] & ((b * 2 != gap) | (free[b] > 1))]
            if len(b):
                return (int(b[0]), gap - int(b[0]))
        if self.triples >> gap & 1:
            for a in range(gap // 3, 0, -1):
                if not have[a]:
                    continue
                rest = gap - a
                b = np.arange((rest + 1) // 2, rest - a + 1)
                c = rest - b
                b = b[(free[b] >= 1 + (b == a) + (b == c)) & (free[c] >= 1 + (c == a) + (b == c)) & (free[a] >= 1 + (b == a) + (c == a))]
                if len(b):
                    return (int(b[0]), rest - int(b[0]), a)
        return None

    def nearest(self, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths with the largest sum that gap holds."""
        self.index()
        sums = (self.singles | self.pairs | self.triples) & ((1 << gap + 1) - 2)
        while sums:
            best = sums.bit_length() - 1
            if found := self.exact(best):
                return found
            sums ^= 1 << best
        return None


Patterns = list[tuple[int, list[tuple[int, int]]]]


def complements(counts: dict[int, int], capacity: int) -> Patterns:
    """From the longest length down, each gap is filled by the one, two or three available lengths that sum to it, or else to the most that fits, until nothing fits.

    A pattern is used as often as all its lengths are available, so that each uses up a length.
    """
    sums = Sums(counts, capacity)
    patterns: Patterns = []
    for length in range(capacity, 0, -1):
        while sums.free[length] > 0:
            need, gap = {length: 1}, capacity - length
            sums.add({length: 1}, -1)
            while gap and (more := sums.nearest(gap)):
                for x in more:
                    need[x] = need.get(x, 0) + 1
                    sums.add({x: 1}, -1)
                gap -= sum(more)
            sums.add(need, 1)
            times = int(min(sums.free[x] // k for x, k in need.items()))
            sums.add(need, -times)
            patterns.append((times, sorted(need.items(), reverse=True)))
    return patterns


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing: from the longest length down, each piece goes to the sequence with the smallest gap that holds it."""
    gaps: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # by gap, how many sequences of which pieces
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in gaps if g >= length), default=capacity)
            many, items = gaps[gap].pop() if gap in gaps else (left, ())
            if gap in gaps and not gaps[gap]:
                del gaps[gap]
            each = min(gap // length, left)
            used = min(many, left // each)
            gaps.setdefault(gap - each * length, []).append((used, (*items, (length, each))))
            if items and used < many:
                gaps.setdefault(gap, []).append((many - used, items))
            left -= used * each
    return [(many, list(items)) for own in gaps.values() for many, items in own]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Patterns (number of sequences, [(length, how many of it)]) that place every piece of the histogram.

    Of the plan by exact complements and plain best-fit decreasing the one with fewer sequences (the first if they are equal), so that
    there are never more than best-fit needs.
    """
    return min(complements(counts, capacity), best_fit(counts, capacity), key=lambda plan: sum(many for many, _ in plan))


def place_table(patterns: Patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, arrays over intervals of ranks: first rank, first sequence, pieces of it per sequence, offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for many, items in patterns:
        offset = 0
        for length, each in items:
            found.setdefault(length, []).append((used.get(length, 0), first, each, offset))
            used[length] = used.get(length, 0) + many * each
            offset += length * each
        first += many
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def _ranked(pieces: DataFrame, id_col: str) -> DataFrame:
    """Adds rank (from 0) among the pieces of the same length."""
    n = pieces.count()
    buckets = math.isqrt(n) + 1  # so many counts per length at most, and about as many rows of a length in a bucket
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", "salt"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "salt")
    return spread.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to written pieces (id, piece, length, ids_crc32, salt). Sequences have no gaps."""
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = pieces.sparkSession.sparkContext.broadcast(place_table(plan_packing(counts, capacity)))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(lengths)), np.int64)
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            first_rank, first, each, offset = shared.value[int(x)]
            k = np.searchsorted(first_rank, ranks[at], side="right") - 1
            into = ranks[at] - first_rank[k]
            out[0, at] = first[k] + into // each[k]
            out[1, at] = offset[k] + into % each[k] * x
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    return _ranked(pieces, id_col).withColumn("place", place("length", "rank")).select("*", "place.sequence_id", "place.offset").drop("place", "rank", "salt")


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes documents once, writes the pieces' lengths, and places every piece."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialize(tokenize_pieces(docs, load_ranks(path), public_tokenizers.PATTERN, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
