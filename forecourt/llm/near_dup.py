"""Near-duplicate classes by Order MinHash, with banded alignment as the exact check.

A text is its sequence of lower-cased words; a character of a script without spaces (Chinese, Japanese, Thai and
the like) is a word of its own. Its k-mers are shingles of five words, each labelled with how many times it has
occurred before. A sketch takes, under its own hash, the ELL labelled shingles of least value and keeps them in the
order of the text, so that it agrees for two texts with a probability that falls with their edit similarity.
SKETCHES sketches give as many bucket keys. A text of SHORT words at most also has the hash of its words and of its
words without each one of them as keys, so that short texts that differ in one word always meet.

Two texts are linked if their words, aligned within a band, have a common subsequence of L words with
L / (n1 + n2 - L) >= 0.8. Whatever lies outside the band of (n1 + n2)(1 - s) / (1 + s) shifts can't reach s, so
the band loses nothing. Words are compared by 32 bits of their hash.

Work on Spark:
1. one pass over the texts writes, per row, a digest of its words, the words' hashes and its bucket keys;
2. exact copies (equal words) are one node, found by a partial aggregate;
3. every bucket has a hub, the member that shares most bucket places, and a text meets the greatest of its hubs.
   Links become components by repeated minimum labels and pointer jumps, on written tables. A text then meets one
   more of its hubs in each other component;
4. members of buckets that still span several components are compared by an exact join: a text's words in order of
   rarity, of which the rarest fifth and one more must hold a word in common for two texts to reach 0.8. Signatures
   of all words bound what two texts can share, so that most of those that can't reach 0.8 never become a pair, and
   texts of one component never meet. So no link of a bucket is lost, no bucket is compared as a whole, and no task
   holds one.

Two shingles a sketch and 40 sketches: texts of 0.8 share about 0.38 of their shingles, and of three at once too little is
shared. A test measures by length and similarity that 0.9 or more of the pairs meet.

Defined cases: texts without a word are never duplicates and have their own id as class; rows that repeat are each
returned with the same class, as are rows of one id with different texts; rows with a null id take part, and a
class has the least id that any of its rows has; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.llm.common import BATCH_ROWS, discard, map_batches, materialize, own_columns, table

WORDS, SIMILARITY = 5, 0.8
ELL, SKETCHES = 2, 40
#: Texts of so many words at most have keys without each one of their words.
SHORT = 17
#: Slots of the hash by which the rarity of words is counted.
LOADS = 1 << 17
#: Bits of a text's signature of words (a multiple of 64 and a power of two), and how many earlier shared words a row carries.
BITS, BEFORE = 1024, 4
#: Characters tokenized at once, to the end of a word.
BLOCK = 1 << 18

# Ranges of code points of scripts that are written without spaces.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def _kinds() -> np.ndarray:
    """Of each code point: 0 for a separator, 1 inside a word, 2 for a word of its own, as all beyond the first plane are."""
    kinds = np.array([chr(i).isalnum() or unicodedata.category(chr(i))[0] == "M" for i in range(1 << 16)] + [True], np.uint8)
    for a, b in UNSPACED:
        kinds[a : b + 1] *= 2
    kinds[-1] = 2
    return kinds


KINDS = _kinds()
BREAK = re.compile(r"\s")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD, INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs."""

    def __init__(self):
        self.up, self.down = _powers(ODD, 1 << 14), _powers(INVERSE, 1 << 14)

    def need(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = _powers(ODD, 2 * n), _powers(INVERSE, 2 * n)


def _block_hashes(points: np.ndarray, powers: Powers) -> np.ndarray:
    kind = KINDS[np.minimum(points, len(KINDS) - 1)]
    before, after = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
    starts = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
    ends = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers.need(len(points))
    values = mix((points.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers.up[: len(points)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str, powers: Powers) -> np.ndarray:
    """Hash of each word of a lower-cased text, in blocks that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK and (m := BREAK.search(text, at + BLOCK)):
            end = m.start()
        out.append(_block_hashes(np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4"), powers))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hash of each k consecutive words; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h ^ words[i : len(words) - k + 1 + i]) + GOLDEN
    return h


def occurrence_labels(xs: np.ndarray) -> np.ndarray:
    """How many times each element has occurred before."""
    order = np.argsort(xs, kind="stable")
    ordered = xs[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.arange(len(xs))
    out = np.empty(len(xs), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


def _labelled(xs: np.ndarray) -> np.ndarray:
    """One hash for each shingle and how many times it has occurred before."""
    return mix(xs + occurrence_labels(xs).astype(np.uint64) * GOLDEN)


SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sketch(xs: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys: hashes of the ELL least labelled shingles in the order of the text."""
    labelled = _labelled(xs)
    keys = np.empty(SKETCHES, np.uint64)
    n = min(ELL, len(xs))
    for i, seed in enumerate(SEEDS):
        values = (labelled ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        least = np.argpartition(values, n - 1)[:n] if n < len(values) else np.arange(len(values))
        least.sort()
        h = int(seed)
        for x in labelled[least].tolist():
            h = ((h ^ x) * 0x100000001B3 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        keys[i] = h
    return keys.view(np.int64)


def short_keys(words: np.ndarray) -> np.ndarray:
    """Hashes of all words, and of all but one of them, of a text that is short enough."""
    n = len(words)
    if not 4 <= n <= SHORT:
        return np.zeros(0, np.int64)
    rows = [words] + [np.delete(words, i) for i in range(n)]
    out = []
    for row in rows:
        h = len(row)
        for x in row.tolist():
            h = ((h ^ x) * 0x100000001B3 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.unique(np.array(out, np.uint64)).view(np.int64)


def with_occurrences(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of words in the upper half of 64 bits, and how often each has occurred before in the lower."""
    return (words.astype(np.int64) << 32) | occurrence_labels(words)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n1 + n2 - L) for the longest common subsequence within the band that `least` allows; 0 if it can't reach least."""
    if len(a) < len(b):
        a, b = b, a
    total = len(a) + len(b)
    if len(b) < least * len(a) - 1e-9 or not len(b):
        return 0.0
    head = int(np.argmin(np.append(a[: len(b)] == b, False)))
    a, b = a[head:], b[head:]
    tail = int(np.argmin(np.append(a[::-1][: len(b)] == b[::-1], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    found = head + tail
    if len(a) and len(b):
        common = found + len(np.intersect1d(with_occurrences(a), with_occurrences(b), assume_unique=True))
        if common * (1 + least) < least * total - 1e-9:
            return 0.0  # not even the common words in any order are enough
        band = int(total * (1 - least) / (1 + least)) + 1
        at: dict[int, int] = {}
        for j, x in enumerate(b.tolist()):
            at[x] = at.get(x, 0) | 1 << j
        all_bits, column, window = (1 << len(b)) - 1, (1 << len(b)) - 1, (1 << 2 * band + 1) - 1
        for i, x in enumerate(a.tolist()):  # one bit per place of b; a zero bit is a step of the subsequence
            m = at.get(x, 0)
            if m:
                m &= window << (i - band) if i >= band else window >> (band - i)
                u = column & m
                column = ((column + u) | (column - u)) & all_bits
        found += len(b) - column.bit_count()
    return found / (total - found)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, text_hash, node (digest of the words, null without words), seq (32-bit hashes of the words), keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        powers = Powers()
        for batch in batches:
            nodes, seqs, keys = [], [], []
            for text in batch.column(2).to_pylist():
                words = word_hashes(text or "", powers)
                nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                seqs.append((words >> np.uint64(32)).astype("<u4").tobytes() if len(words) else None)
                keys.append(np.concatenate((sketch(shingles(words)), short_keys(words))) if len(words) else None)
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(seqs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "node", "seq", "keys"])

    lowered = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.lower(F.col(text_col)).alias("text"))
    return map_batches(lowered, run, f"id {kind}, text_hash bigint, node binary, seq binary, keys array<bigint>")


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """Written (a, b, similarity) of the pairs (a, b) of nodes whose words are similar enough."""
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def similar(a, b):
        return pd.Series([aligned_similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, b, strict=True)], dtype="float64")

    similar.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    once = F.pandas_udf(similar, "double").asNondeterministic()  # else the filter aligns the pairs and the column aligns the similar ones again
    # The same joins at every size: whether candidates could be broadcast depends on the size of the input.
    by = pairs.hint("merge").join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b").hint("merge").join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a")
    return materialize(by.select("a", "b", once("seq_a", "seq_b").alias("similarity")).where(F.col("similarity") >= SIMILARITY), "links")


def components(links: DataFrame) -> DataFrame:
    """Written (node, class): a node of each connected component of links (a, b) as its class, for nodes that have a link.

    Each round gives every node its least neighbour's least neighbour (itself where it is less) as class. Then links go
    between classes, and those within one are gone, so that rounds get smaller. Nodes are digests, whose order has
    nothing to do with the links, so that a share of them is left over each time however the links run.
    """
    edges = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        near = materialize(ends.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("class")), "nearest")
        up = near.select(F.col("node").alias("class"), F.col("class").alias("up"))
        step = materialize(near.join(up, "class").select("node", F.col("up").alias("class")), "step")
        to = lambda c: step.select(F.col("node").alias(c), F.col("class").alias(f"to_{c}"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b")
        rest = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        before, label = label, step
        if before is not None:
            again = step.select(F.col("node").alias("class"), F.col("class").alias("to"))
            label = materialize(before.join(again, "class", "left").select("node", F.coalesce("to", "class").alias("class")), "classes")
            discard(before, step)
        discard(near, edges)
        edges = rest
        if edges.isEmpty():
            discard(edges)
            return label


def with_classes(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the class of the column node; a node without a link is its own."""
    of = parts.select(F.col("node").alias("_of"), F.col("class").alias("_class"))
    return rows.hint("merge").join(of, F.col(node) == F.col("_of"), "left").withColumn(name, F.coalesce("_class", node)).drop("_of", "_class")


def word_loads(seqs: DataFrame) -> np.ndarray:
    """How many words (each with how often it has occurred before) of the texts fall to each of LOADS slots of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LOADS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(slots_of(with_occurrences(np.frombuffer(x, "<u4"))), minlength=LOADS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    found = map_batches(seqs.select("seq"), run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # LOADS rows at most
    loads = np.zeros(LOADS, np.int64)
    loads[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return loads


def slots_of(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.view(np.uint64)) >> np.uint64(64 - LOADS.bit_length() + 1)).astype(np.int64)


def rare_words(seqs: DataFrame, loads: np.ndarray) -> DataFrame:
    """node, n (words), i (place), token: of each text the first n - ceil(s n) + 1 words in the order of their slots' loads and then their hash.

    A word that is alone in its slot is in no other text, so that it makes no row.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(loads)  # 8 * LOADS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, places, tokens = [], [], [], []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = with_occurrences(np.frombuffer(x, "<u4"))
                load, n = shared.value[slots_of(own)], len(own)
                first = np.lexsort((own, load))[: n - math.ceil(SIMILARITY * n - 1e-9) + 1]
                kept = np.flatnonzero(load[first] > 1)
                nodes += [node] * len(kept)
                counts += [n] * len(kept)
                places.append(kept)
                tokens.append(own[first[kept]])
            columns = [pa.array(nodes, pa.binary()), pa.array(counts, pa.int32())]
            columns += [pa.array(np.concatenate(x) if x else [], t) for x, t in ((places, pa.int32()), (tokens, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "i", "token"])

    return map_batches(seqs.select("node", "seq"), run, "node binary, n int, i int, token bigint")


def signatures(seqs: DataFrame) -> DataFrame:
    """node, sig: BITS bits, each the parity of how many words (with how often each has occurred before) of the text fall to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = []
            for x in batch.column(1).to_pylist():
                at = mix(with_occurrences(np.frombuffer(x, "<u4")).view(np.uint64) ^ GOLDEN) >> np.uint64(64 - BITS.bit_length() + 1)
                sigs.append(np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], names=["node", "sig"])

    return map_batches(seqs.select("node", "seq"), run, "node binary, sig array<bigint>")


def across_components(places: DataFrame, parts: DataFrame, seqs: DataFrame) -> DataFrame:
    """Written links (a, b) between different components, of nodes that share a bucket which spans several of them.

    Two texts of n1 <= n2 words that reach the similarity s have m = s / (1 + s) * (n1 + n2) words in common at least,
    which is s * n2 or more. So, whatever the order of all words, the first n - ceil(s * n) + 1 words of both hold one
    in common, and behind the first such word enough are left in both to make up m. Words (each with how often it
    has occurred before) are ordered by how few of these texts' words share their slot of a hash, so that those of
    passages or phrases that many texts share come last and hardly ever make a pair.

    Each bit in which two signatures differ stands for a word at least that only one of the texts has, so that texts
    that differ in more bits than n1 + n2 - 2 m can't be linked. Of a word's rows those of its largest component
    are on one side only, so that a large component isn't joined with itself. A pair is dropped at a word if
    both rows know of an earlier one that the texts share: it has been there, or was ruled out there by its place.
    """
    placed = with_classes(places.select("key", "node"), parts, "node", "class")
    split = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key", "low")
    placed = materialize(placed.hint("merge").join(split, "key").select("node", "class", "low").distinct(), "split")
    # Components that such buckets connect are a group; only within groups can there be a pair.
    groups = components(placed.where("class != low").select(F.col("low").alias("a"), F.col("class").alias("b")).distinct())
    groups = groups.select(F.col("node").alias("class"), F.col("class").alias("group"))
    members = materialize(placed.select("node", "class").distinct(), "members")
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    before, members = members, materialize(members.hint("merge").join(groups.join(sizes, "class"), "class"), "members")
    discard(before)
    own = materialize(seqs.hint("merge").join(members.select("node"), "node", "left_semi"), "split_words")
    rare = materialize(members.hint("merge").join(rare_words(own, word_loads(own)), "node"), "rare_words")
    sums = [F.count("*").alias("rows"), F.sum("n").alias("sum_n"), F.sum("i").alias("sum_i"), F.min("n").alias("least_n"), F.max(F.col("n") - F.col("i") * (1 + SIMILARITY)).alias("reach")]
    shared = rare.groupBy("group", "token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.struct("size", "class"))["class"].alias("main"), *sums).where("low != high").drop("low", "high")
    enough = lambda n, i, n_b, i_b: F.least(n - i, n_b - i_b) * (1 + SIMILARITY) >= SIMILARITY * (n + n_b) - 1e-6
    n, i = F.col("n"), F.col("i")
    # Whether any of the word's rows can be this one's partner: of two rows it is the other one, of more a bound over all.
    some = F.when(F.col("rows") == 2, enough(n, i, F.col("sum_n") - n, F.col("sum_i") - i))
    some = some.otherwise((n - i * (1 + SIMILARITY) >= SIMILARITY * F.col("least_n") - 1e-6) & (F.col("reach") >= SIMILARITY * n - 1e-6))
    kept = materialize(rare.hint("merge").join(shared, ["group", "token"]).where(some).select("group", "token", "node", "class", "n", "i", "main"), "shared_words")
    before = F.collect_list("token").over(Window.partitionBy("node").orderBy("i").rowsBetween(-BEFORE, -1))
    signed = materialize(kept.hint("merge").join(signatures(own), "node").withColumn("before", before), "signed_words")
    other = signed.select("group", "token", *(F.col(c).alias(f"{c}_b") for c in ("node", "class", "n", "i", "sig", "before")))
    apart = (F.col("class") != F.col("class_b")) & ((F.col("class_b") == F.col("main")) | (F.col("class") < F.col("class_b")))
    differing = F.aggregate(F.zip_with("sig", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    alike = (F.col("n") + F.col("n_b") - differing) * (1 + SIMILARITY) >= 2 * SIMILARITY * (F.col("n") + F.col("n_b")) - 1e-6
    first = ~F.arrays_overlap("before", "before_b")
    met = signed.where("class != main").hint("merge").join(other, ["group", "token"]).where(apart & enough(n, i, F.col("n_b"), F.col("i_b")) & first & alike)
    pairs = met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    found = verified(pairs, own)
    discard(placed, members, own, rare, kept, signed)
    return found


def find_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written rows (id, text_hash, node), links (a, b, similarity) between different nodes, and classes (node, class)."""
    rows = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"))
    all_places = materialize(nodes.select("node", F.explode(F.array_distinct("keys")).alias("key")), "all_places")
    counted = all_places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = materialize(all_places.hint("merge").join(counted, "key"), "places")
    discard(all_places)
    degree = places.groupBy("node").agg(F.sum("n").alias("degree"))
    seqs = rows.where("node is not null").select("node", "seq").dropDuplicates(["node"])
    seqs = materialize(seqs.hint("merge").join(degree.select("node"), "node", "left_semi"), "words")
    hubs = places.hint("merge").join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    met = materialize(places.hint("merge").join(hubs, "key").where("node != hub.node").select("node", "hub").distinct(), "met")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = verified(met.groupBy("node").agg(F.max("hub").alias("hub")).select(*pair("node", "hub.node")).distinct(), seqs)
    parts = components(links)
    apart = with_classes(with_classes(met.select("node", F.col("hub.node").alias("hub")), parts, "node", "class"), parts, "hub", "hub_class")
    # Then it meets one of its hubs in each other class; whatever else there is to find is left to the exact join.
    apart = apart.where("class != hub_class").groupBy("node", "hub_class").agg(F.max("hub").alias("hub"))
    links = links.unionByName(verified(apart.select(*pair("node", "hub")).distinct(), seqs))
    parts = components(links)
    discard(met)
    more = across_components(places, parts, seqs)
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = components(links)
    discard(places, seqs)
    return rows.select("id", "text_hash", "node"), links, parts


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, rep (least id with the same words), class_id (least id of the near-duplicate class), n_links.

    n_links counts the links found between the row's words and different ones; in a class of more than two not every
    pair needs to have been compared.
    """
    rows, links, parts = find_links(docs, id_col, text_col)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"))
    placed = nodes.join(parts, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = placed.groupBy("class").agg(F.min("rep").alias("class_id"))
    counts = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = placed.join(least, "class").join(counts, "node", "left").select("node", "rep", "class_id", "n_links")
    found = rows.hint("merge").join(placed, "node", "left")
    alone = F.col("node").isNull()
    own = lambda c: F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c)
    return found.select("id", own("rep"), own("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, and all rows without words; columns and their order stay.

    The row with the least id stays (a null id comes last), of rows with that id the one with the least hash of its
    text, and of equal rows of these one.
    """
    rows, _, parts = find_links(docs, id_col, text_col)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(key).alias("key"))
    kept = nodes.join(parts, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("key").alias("key"))
    wordless = rows.where("node is null").select(F.col("id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    chosen = materialize(kept.select(F.col("key.id").alias("k_id"), F.col("key.text_hash").alias("k_hash")), "kept")
    own_hash = F.xxhash64(F.col(f"`{text_col}`"))
    same = lambda keys: docs[id_col].eqNullSafe(keys["k_id"]) & (own_hash == keys["k_hash"])
    n = rows.where("node is not null").groupBy(F.col("id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(chosen.join(n.drop("n"), chosen["k_id"].eqNullSafe(n["k_id"]) & (chosen["k_hash"] == n["k_hash"]), "left_semi"), "repeated")
    if again.isEmpty():
        keys = chosen.unionByName(wordless)
        return docs.join(keys.hint("merge"), same(keys), "left_semi").select(*own_columns(docs))
    keys = chosen.join(again.hint("merge"), chosen["k_id"].eqNullSafe(again["k_id"]) & (chosen["k_hash"] == again["k_hash"]), "left_anti").unionByName(wordless)
    once = docs.join(again.hint("merge"), same(again), "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(keys.hint("merge"), same(keys), "left_semi").unionByName(once).select(*own_columns(docs))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_of"), "class_id", "n_links")
