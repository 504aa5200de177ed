"""Secret scan: fixed patterns, and formats inferred as probabilistic automata from credentials those patterns label.

Base spans are the leftmost non-overlapping matches of three patterns, without those that are too short. Their
values are labelled examples of a format. For each kind a prefix tree is built from a bounded sample of examples,
and its states are merged while their outgoing and ending frequencies agree within Hoeffding bounds; merged subtrees
are folded so that the automaton stays deterministic.

Candidates are all runs of credential characters of SHORTEST characters or more, without signs at their ends, and
their parts between signs. Each is scored by its log-likelihood under the best automaton less that under a model of
ordinary runs of the same texts, a character; those that lead as nearly all held-out examples do, and more than
ordinary runs, become further spans (kind grammar), unless a base span holds them.

Defined cases: null counts as empty; a text without secrets has counts 0 and the hash of the empty string; rows
that repeat are each scanned; without enough labelled examples (a dozen of a kind) only base spans are found; of
parts of a run the longest that passes is taken, of equally long ones the first; whole texts are scanned whatever
their length; an empty table gives no rows; other columns stay as they are, and a name for the spans that is taken
already is an error.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import BATCH_ROWS, discard, map_batches, materialize, own_columns, table

# Patterns, least lengths, and the order of kinds.
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A run of credential characters is a candidate from this length on, which is the least that a labelled value has.
SHORTEST = min(LEAST.values())
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
WHOLE, PART = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9])?=*"), re.compile(r"[A-Za-z0-9_-]+")
#: Ordinary runs: words, also joined by signs; with digits only such as are too short to be a credential.
PLAIN = re.compile(rf"(?<![^\s(\"'])(?:[A-Za-z]{{3,}}(?:[+/_.=-][A-Za-z]+)*|[A-Za-z0-9+/_.=-]{{3,{SHORTEST - 1}}})(?![^\s.,;:!?)\"'])")
#: Different examples of each kind and ordinary runs that the automata learn from; longer examples aren't learned from.
MAX_EXAMPLES, MAX_WORDS, MAX_LENGTH = 1000, 3000, 256
#: Significance of the Hoeffding test, and the counts under which states say too little to be told apart.
ALPHA, LEAST_COUNT = 0.05, 12
#: Share of the examples at a state that makes a character an arc of its own.
LITERAL = 0.15
#: Least lead over ordinary runs, in log-likelihood a character.
MARGIN = 0.25


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


#: The leftmost non-overlapping matches of HEX are the maximal runs, so the long ones can be asked for at once.
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")


# The classes of characters that a position of a format may be drawn from, the narrowest first.
LADDER = (
    string.digits,
    "0123456789abcdef",
    "0123456789ABCDEF",
    string.ascii_lowercase,
    string.ascii_uppercase,
    string.digits + string.ascii_lowercase,
    string.digits + string.ascii_uppercase,
    string.ascii_letters,
    string.digits + string.ascii_letters,
    string.digits + string.ascii_letters + "+/_.=-",
)


class Automaton:
    """A probabilistic deterministic automaton, merged from a prefix tree of examples.

    An arc of the prefix tree is a character if enough of the examples at its state have it, and for all others the
    narrowest class of LADDER that holds them; so random parts of a format stay one path, on which counts say
    something. States are merged in the red-blue order while the shares of their arcs and ends agree within Hoeffding
    bounds, there and below.
    """

    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = []
        self.count: list[Counter] = []
        self.ends: list[int] = []
        self._grow(examples)
        self._merge()

    def _grow(self, examples: list[str]) -> None:
        todo: list[tuple[int, str, list[str], int]] = [(-1, "", examples, 0)]
        while todo:
            parent, arc, own, depth = todo.pop()
            at = len(self.next)
            if parent >= 0:
                self.next[parent][arc] = at
            by: dict[str, list[str]] = defaultdict(list)
            for x in own:
                by[x[depth : depth + 1]].append(x)
            self.next.append({})
            self.ends.append(len(by.pop("", ())))
            frequent = {c for c, xs in by.items() if len(xs) >= max(LEAST_COUNT, LITERAL * len(own))}
            arcs = {c: by[c] for c in frequent}
            others = by.keys() - frequent
            if others:
                arcs[next((k for k in LADDER if others <= set(k)), LADDER[-1])] = sorted(x for c in others for x in by[c])
            self.count.append(Counter({c: len(xs) for c, xs in arcs.items()}))
            todo += [(at, c, xs, depth + 1) for c, xs in sorted(arcs.items())]

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            n1, n2 = self._total(a), self._total(b)
            if a == b or (a, b) in seen or min(n1, n2) < LEAST_COUNT:
                continue
            seen.add((a, b))
            if self._differ(self.ends[a], n1, self.ends[b], n2) or any(self._differ(self.count[a][c], n1, self.count[b][c], n2) for c in self.count[a].keys() | self.count[b].keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a, making transitions that both have one."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: -self._total(self.next[x[0]][x[1]]))
            source, c = blue.pop(0)
            b = self.next[source][c]
            if b in red:
                continue
            into = next((r for r in red if self._compatible(r, b)), None)
            if into is None:
                red.append(b)
            else:
                self.next[source][c] = into
                self._fold(into, b)
            seen = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in seen]
        self.states, self.totals = [{c: (to, self.count[q][c]) for c, to in self.next[q].items()} for q in red], [(self._total(q), self.ends[q]) for q in red]
        kept = {q: i for i, q in enumerate(red)}
        self.states = [{c: (kept[to], n) for c, (to, n) in arcs.items()} for arcs in self.states]

    def plain(self) -> tuple[list[dict[str, tuple[int, float]]], list[float], list[float]]:
        """Of each state: by character, the next state and the log probability; that of ending; that of any other character."""
        arcs, end, rare = [], [], []
        for by, (n, ends) in zip(self.states, self.totals, strict=True):
            own: dict[str, tuple[int, float]] = {}
            for c in sorted(by, key=lambda c: -len(c)):  # a character of its own, or a narrower class, hides a wider class
                to, k = by[c]
                own |= dict.fromkeys(c, (to, math.log(k / (n + 1)) - math.log(len(c))))
            arcs.append(own)
            end.append(math.log((ends + 0.1) / (n + 1)))
            rare.append(math.log(0.05 / (n + 1) / 68))
        return arcs, end, rare


def word_model(words: list[str]) -> dict[str, dict[str, float]]:
    """Log probabilities of characters after each character, from runs that aren't credentials; "" begins and ends a run."""
    pairs: dict[str, Counter] = defaultdict(Counter)
    for x in words:
        for a, b in itertools.pairwise(["", *x, ""]):
            pairs[a][b] += 1
    size = 70
    found = {a: {b: math.log((n + 0.1) / (sum(own.values()) + 0.1 * size)) for b, n in own.items()} for a, own in pairs.items()}
    for a, own in pairs.items():
        found[a]["rare"] = math.log(0.1 / (sum(own.values()) + 0.1 * size))
    return found


class Grammar:
    """Scores runs by formats, which are plain values, so that they can be broadcast without this module."""

    def __init__(self, model: dict):
        self.formats, self.words, self.least = model["formats"], model["words"], model["least"]
        self.known: dict[str, tuple[float, bool]] = {}

    def plain_log(self, x: str) -> float:
        last, total = "", 0.0
        for c in (*x, ""):
            own = self.words.get(last, {})
            total += own.get(c, own.get("rare", -math.log(70)))
            last = c
        return total

    def format_log(self, kind: str, x: str) -> float:
        """Log-likelihood; a character without an arc leaves the state as it is, but only one in SHORTEST may do so."""
        arcs, end, rare = self.formats[kind]
        at, total, left = 0, 0.0, len(x) // SHORTEST
        for c in x:
            arc = arcs[at].get(c)
            if arc is None:
                if not left:
                    return -math.inf
                left -= 1
                total += rare[at]
            else:
                at = arc[0]
                total += arc[1]
        return total + end[at]

    def lead(self, x: str) -> tuple[float, bool]:
        """By how much a character the best format explains x better than ordinary runs do, and whether that is enough."""
        if x in self.known:
            return self.known[x]
        logs = {k: v for k in self.formats if (v := self.format_log(k, x)) > -math.inf}
        plain = self.plain_log(x) if logs else 0.0
        leads = {k: (v - plain) / max(1, len(x)) for k, v in logs.items()}
        found = max(leads.values(), default=-math.inf), any(v >= self.least[k] for k, v in leads.items())
        if len(self.known) < 1 << 16:
            self.known[x] = found
        return found

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Base spans, and those of runs (or of their disjoint parts, the longest first) that look like a format and that no base span holds."""
        if not self.formats:
            return base
        more, k, held = [], 0, (0, -1)
        for m in RUN.finditer(text):
            while k < len(base) and base[k][0] < m.end():
                if base[k][1] > held[1]:
                    held = base[k][:2]
                k += 1
            own: list[tuple[int, int, str]] = []
            for a, b in candidates(text, m.start(), m.end()):
                if not (held[0] <= a and b <= held[1]) and all(b <= x or y <= a for x, y, _ in own) and self.lead(text[a:b])[1]:
                    own.append((a, b, "grammar"))
            more += own
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run without signs at its ends, and its parts between signs that join words; those that are long enough, the longest first."""
    found = []
    for m in itertools.chain(WHOLE.finditer(text, start, end), PART.finditer(text, start, end)):
        if m.end() - m.start() >= SHORTEST and m.span() not in found:
            found.append(m.span())
    return sorted(found, key=lambda x: (x[0] - x[1], x[0]))


def build(examples: dict[str, list[str]], words: list[str]) -> dict:
    """Plain values of a Grammar. A fifth of the examples of each kind, held out, sets the least lead of its format.

    The least lead is half way between what all but a fiftieth of the held-out examples have and what all but a
    thousandth of the ordinary runs don't (those that no format takes count as -1), and MARGIN at least.
    """
    model = {"formats": {}, "words": word_model(words), "least": {}}
    for kind, xs in examples.items():
        xs = sorted(xs)
        held = [x for x in xs if zlib.crc32(x.encode()) % 5 == 0]
        rest = [x for x in xs if zlib.crc32(x.encode()) % 5]
        if len(rest) < LEAST_COUNT or not held:
            continue
        one = Grammar({"formats": {kind: Automaton(rest).plain()}, "words": model["words"], "least": {kind: 0.0}})
        good = sorted(one.lead(x)[0] for x in held)
        plain = sorted(max(one.lead(x)[0], -1.0) for x in words if len(x) >= SHORTEST)
        model["formats"][kind] = Automaton(xs).plain()
        top = plain[-1 - len(plain) // 1000] if plain else 0.0
        model["least"][kind] = max((good[len(good) // 50] + top) / 2, MARGIN)
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credential values by kind and ordinary runs: of each task those with the smallest hashes."""
    rank = lambda x: zlib.crc32(x.encode())
    best: dict[str, dict[str, int]] = {k: {} for k in ("assign", "access", "hex", "word")}
    most = dict.fromkeys(best, MAX_EXAMPLES) | {"word": MAX_WORDS}
    cut = dict.fromkeys(best, 1 << 32)

    def add(kind: str, x: str) -> None:
        own = best[kind]
        if x not in own and (r := rank(x)) <= cut[kind]:
            own[x] = r
            if len(own) > 4 * most[kind]:
                best[kind] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[: most[kind]])
                cut[kind] = max(best[kind].values())

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for a, b, kind in base_spans(text or ""):
                x = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                if len(x) <= MAX_LENGTH:
                    add(kind, x)
            for x in set(PLAIN.findall(text or "")):
                add("word", x)
    rows = [(k, x, h) for k, found in best.items() for x, h in sorted(found.items(), key=lambda x: (x[1], x[0]))[: most[k]]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "value", "rank"])


def learn(docs: DataFrame, text_col: str = "text") -> dict:
    """Plain values of a Grammar. Of the examples of all texts the MAX_EXAMPLES of each kind, and MAX_WORDS ordinary runs, with the smallest hashes reach the driver."""
    texts = docs.select(F.col(text_col).alias("text"))
    found = materialize(map_batches(texts, _examples, "kind string, value string, rank bigint").dropDuplicates(["kind", "value"]), "examples")
    rows = [r for k in ("assign", "access", "hex", "word") for r in found.where(F.col("kind") == k).orderBy("rank", "value").limit(MAX_WORDS if k == "word" else MAX_EXAMPLES).collect()]
    discard(found)
    examples: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        examples[r["kind"]].append(r["value"])
    words = examples.pop("word", [])
    return build(dict(examples), words)


def find(docs: DataFrame, model: dict, name: str = "secrets", text_col: str = "text") -> DataFrame:
    """All columns of docs, and under `name` (which must be new) array<struct<kind, start, end>> (code points, end exclusive)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared = spark.sparkContext.broadcast(model)

    def scan(parts):
        grammar = Grammar(shared.value)
        for texts in parts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in grammar.spans(x or "", base_spans(x or ""))] for x in texts])

    scan.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")
    return docs.withColumn(name, F.pandas_udf(scan, "array<struct<kind: string, start: bigint, end: bigint>>")(F.col(f"`{text_col}`")))


def joined(spans):
    """kind:start:end, comma-joined, of an array of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans):
    """Disjoint (start, end) that cover the spans, in order."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(spans, F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), step)


def redact(docs: DataFrame, model: dict, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark; n_chars, where there is one, follows."""
    found = find(docs, model, "_forecourt_spans").withColumn("_forecourt_cover", F.when(F.size("_forecourt_spans") > 0, merged(F.col("_forecourt_spans"))))
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    before = F.zip_with(F.col("_forecourt_cover"), F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_forecourt_cover", lambda s: s["end"])), lambda s, at: F.when(s.isNotNull(), F.concat(piece(at, s["start"]), F.lit(mark))).otherwise(piece(at, F.char_length("text").cast("bigint"))))
    found = found.withColumn("text", F.when(F.col("_forecourt_cover").isNotNull(), F.array_join(before, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("_forecourt_cover").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*own_columns(docs))


def op10_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs)).drop("text")
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), of("grammar"))
