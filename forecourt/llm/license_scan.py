"""License scan by conditional compression.

A template is one wording of a license: a notice of a line, a short license, or a whole text out of the folder
`licenses`. A brace pair {} in a wording stands for up to SLOT words of any kind, such as a year and an owner.

1. Candidate blocks. A wording of n words can be confirmed only where at least `least` of them (nine tenths) stand. So
   one of its n - least + 1 longest words must be there, and the words around it must hold that many of its words.
   That is a bound, not a guess: what it leaves out can't be confirmed.
2. Ranking. Every candidate block is compressed with each of its templates as raw zstandard dictionary; templates are
   ranked by the size that this saves, as a share of the size without a dictionary.
3. Confirmation. In that order a template is aligned with the block word by word so that as few words as can be differ.
   It is confirmed if at least nine tenths of the template's words are matched and these are at least four fifths of
   the words that they span. Of confirmed ones that overlap the one with the smallest share of differing words wins,
   unless all its words are among those of another; between equals the larger saving decides. The words before and
   after are scanned again until nothing is confirmed. Spans are those of the matched words.

Defined cases: null counts as empty; a text without candidates has no license; rows that repeat are each scanned; of
templates that fit equally well the one first in the order of names is taken; whole texts are scanned whatever their
length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import glob
import itertools
import math
import re
from collections.abc import Iterator
from importlib import resources
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, table

# Notices and short texts by license; a license may have several wordings.
NOTICES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of {} nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": ("All rights reserved.", "Copyright {} All rights reserved.", "All rights reserved. Copyright"),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

#: Least share of a template's words that are matched, and of the words of their span (slots left out) that they are.
LEAST_SHARE, LEAST_OF_SPAN = 0.9, 0.8
#: Words that a slot may hold.
SLOT = 8
LEVEL = 3
MATCH, MISSING, INSERTED = 0, 1, 2
#: Costs of a template's word without a partner and of a word between, tried in turn: few differences (of equally many, few missing words), then few missing words.
COSTS = ((101, 100), (400, 100), (1600, 100))


def templates(folder: str | None = None) -> dict[str, tuple[str, ...]]:
    """Wordings by license: the notices above, and the text files of a folder (by default those of this package) as NAME-text."""
    found = {name: (x,) if isinstance(x, str) else x for name, x in NOTICES.items()}
    for path in resources.files("forecourt.llm").joinpath("licenses").iterdir() if folder is None else map(Path, sorted(glob.glob(f"{folder}/*.txt"))):
        if path.name.endswith(".txt"):
            name = f"{path.name[:-4]}-text"
            found[name] = (*found.get(name, ()), path.read_text(encoding="utf-8"))
    return found


def least_words(n: int) -> int:
    return math.ceil(LEAST_SHARE * n - 1e-9)


class Wording(NamedTuple):
    name: str
    text: str
    words: list[str]
    slots: frozenset[int]
    least: int
    reach: int


def wordings(known: dict[str, tuple[str, ...]]) -> list[Wording]:
    out = []
    for name in sorted(known):
        for text in known[name]:
            words, slots = [], set()
            for part in re.split(r"(\{\})", text):
                if part == "{}":
                    slots.add(len(words))
                words += [] if part == "{}" else [w.lower() for w in WORD.findall(part)]
            least = least_words(len(words))
            out.append(Wording(name, text.replace("{}", ""), words, frozenset(slots), least, math.ceil(len(words) / LEAST_OF_SPAN) + SLOT * len(slots)))
    return out


class Match(NamedTuple):
    """A wording in a run of words: indices of the matched words, and the differing words (- template only, + text only)."""

    template: int
    matched: list[int]
    differ: list[str]
    saving: float


class Scanner:
    """Compressors with each wording as raw dictionary, and the wordings' words."""

    def __init__(self, known: dict[str, tuple[str, ...]]):
        import zstandard

        self.wordings = wordings(known)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.primed = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(w.text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.wordings]
        self.tails = [WORD.split(w.text)[-1].rstrip() for w in self.wordings]
        self.numbers = {w: i for i, w in enumerate(sorted({w for own in self.wordings for w in own.words}))}
        self.ids = [np.array([self.numbers[w] for w in own.words], np.int32) for own in self.wordings]
        self.counts = [np.bincount(own, minlength=len(self.numbers)) for own in self.ids]
        self.cues: dict[int, list[int]] = {}  # by word, the wordings whose longest words it is among
        for i, own in enumerate(self.wordings):
            longest = sorted(own.words, key=lambda w: (-len(w), w))[: len(own.words) - own.least + 1]
            for w in set(longest):
                self.cues.setdefault(self.numbers[w], []).append(i)

    def split(self, text: str) -> tuple[list[tuple[int, int]], list[str], np.ndarray]:
        """Spans of the words, the words in lower case, and their numbers (-1 for those of no template)."""
        at, words = [], []
        for m in WORD.finditer(text):
            at.append(m.span())
            words.append(m[0].lower())
        return at, words, np.array([self.numbers.get(w, -1) for w in words], np.int32)

    def candidates(self, ids: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
        """(wording, first word, end) of the blocks within words a to b where a wording can be confirmed at all."""
        places: dict[int, list[int]] = {}
        for k in (np.flatnonzero(ids[a:b] >= 0) + a).tolist():
            for i in self.cues.get(int(ids[k]), ()):
                places.setdefault(i, []).append(k)
        out = []
        for i, ks in places.items():
            own = self.wordings[i]
            if b - a < own.least:
                continue
            blocks: list[list[int]] = []
            for k in ks:
                start, end = max(a, k - own.reach), min(b, k + own.reach + 1)
                if blocks and start <= blocks[-1][1]:
                    blocks[-1][1] = end
                else:
                    blocks.append([start, end])
            for start, end in blocks:
                held = ids[start:end]
                held = held[held >= 0]
                if len(held) >= own.least and np.minimum(self.counts[i], np.bincount(held, minlength=len(self.numbers))).sum() >= own.least:
                    out.append((i, start, end))
        return out

    def saving(self, i: int, raw: bytes) -> float:
        """Bytes that wording i as dictionary saves, as a share of the size without it."""
        alone = len(self.plain.compress(raw))
        return (alone - len(self.primed[i].compress(raw))) / alone

    def costs(self, i: int, ids: np.ndarray, weights: tuple[int, int], steps: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Least costs of aligning wording i so that it ends at each place of ids, and the steps there."""
        own, (missing, inserted) = self.wordings[i], weights
        ramp = inserted * np.arange(len(ids) + 1, dtype=np.int32)
        row = np.zeros(len(ids) + 1, np.int32)  # a notice may begin anywhere
        taken = np.zeros((len(own.words) + 1, len(ids) + 1), np.uint8) if steps else None
        for k, t in enumerate(self.ids[i], 1):
            before = row + missing
            same = np.flatnonzero(ids == t) + 1
            best = before.copy()
            best[same] = np.minimum(best[same], row[same - 1])
            row = np.minimum.accumulate(best) if k in own.slots else np.minimum.accumulate(best - ramp) + ramp
            if taken is not None:
                taken[k] = np.where(row == before, MISSING, INSERTED)
                matched = same[row[same] == best[same]]
                taken[k, matched[best[matched] < before[matched]]] = MATCH
        return row, taken

    def aligned(self, i: int, words: list[str], ids: np.ndarray, at: int, a: int, b: int, weights: tuple[int, int]) -> Match | None:
        """Wording i, by the given costs, with the words whose numbers are ids (the first has index at), to end at the last; words from a to b may stand in place of its ends."""
        own = self.wordings[i]
        _, taken = self.costs(i, ids, weights, True)
        k, j = len(own.words), len(ids)
        steps: list[tuple[int | None, int | None, bool]] = []  # from the end: template's word, word, whether in a slot
        while k:
            step = taken[k, j]
            if step == MATCH:
                k, j = k - 1, j - 1
                steps.append((k, j + at, False))
            elif step == MISSING:
                k -= 1
                steps.append((k, None, False))
            else:
                j -= 1
                steps.append((None, j + at, k in own.slots))
        steps.reverse()
        matched = [j for k, j, _ in steps if k is not None and j is not None]
        if len(matched) < own.least:
            return None
        first, last = (next(n for n, (k, j, _) in enumerate(x) if k is not None and j is not None) for x in (steps, steps[::-1]))
        inner = steps[first : len(steps) - last]
        in_slots = sum(x for *_, x in inner)
        between = sum(k is None and not x for k, _, x in inner)
        if in_slots > SLOT * len(own.slots) or len(matched) < LEAST_OF_SPAN * (len(matched) + between) - 1e-9:
            return None
        before = [(None, j, False) for j in range(max(a, matched[0] - first), matched[0])]
        after = [(None, j, False) for j in range(matched[-1] + 1, min(b, matched[-1] + 1 + last))]
        differ: list[str] = []
        for same, run in itertools.groupby(before + [x for x in steps if not x[2]] + after, lambda x: x[0] is not None and x[1] is not None):
            if not same:
                part = list(run)
                differ += [f"-{own.words[k]}" for k, _, _ in part if k is not None] + [f"+{words[j]}" for _, j, _ in part if j is not None]
        return Match(i, matched, differ, 0.0)

    def matches(self, text: str, at: list[tuple[int, int]], words: list[str], ids: np.ndarray, a: int, b: int) -> list[Match]:
        """Confirmed alignments with words a to b, in the order of what their templates save; of those of one template that overlap, the best."""
        ranked = []
        for i, start, end in self.candidates(ids, a, b):
            raw = text[at[start][0] : at[end - 1][1]].lower().encode("utf-8", "surrogatepass")
            ranked.append((-self.saving(i, raw), i, start, end))
        out = []
        for saving, i, start, end in sorted(ranked):
            own = self.wordings[i]
            taken = np.zeros(end - start + 1, bool)
            for weights in COSTS:
                cost, _ = self.costs(i, ids[start:end], weights, False)
                most = weights[0] * (len(own.words) - own.least) + weights[1] * len(own.words) * (1 - LEAST_OF_SPAN) / LEAST_OF_SPAN + 1e-6
                ends = np.flatnonzero(cost[1:] <= most) + 1
                for k in ends[np.argsort(cost[ends], kind="stable")].tolist():
                    first = max(start, start + k - own.reach)
                    if not taken[k] and (found := self.aligned(i, words, ids[first : start + k], first, a, b, weights)):
                        taken[found.matched[0] - start + 1 : found.matched[-1] - start + 2] = True
                        out.append(found._replace(saving=-saving))
        return out

    def best_first(self, found: list[Match]) -> list[Match]:
        """A match whose words are all, and not the only ones, of another is left out."""
        sets = [frozenset(x.matched) for x in found]
        near: list[int] = []  # those that reach to the match at hand
        dropped = set()
        for k in sorted(range(len(found)), key=lambda k: found[k].matched[0]):
            near = [x for x in near if found[x].matched[-1] >= found[k].matched[0]]
            for x in near:
                dropped |= {k} if sets[k] < sets[x] else {x} if sets[x] < sets[k] else set()
            near.append(k)
        by = lambda x: (len(x.differ) / len(self.wordings[x.template].words), -len(x.matched), -x.saving, x.template)
        return sorted((x for k, x in enumerate(found) if k not in dropped), key=by)

    def confirm(self, block: str) -> tuple[str, float, int, list[str]] | None:
        """Winner, its saving, how many words differ and which (- template only, + block only)."""
        at, words, ids = self.split(block)
        ranked = self.best_first(self.matches(block, at, words, ids, 0, len(words))) if words else []
        return (self.wordings[ranked[0].template].name, ranked[0].saving, len(ranked[0].differ), ranked[0].differ) if ranked else None

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """How many candidate blocks there are, and every confirmed notice: those that overlap no better one, then what the words left between them hold, until nothing is confirmed."""
        at, words, ids = self.split(text)
        n_blocks = len({(a, b) for _, a, b in self.candidates(ids, 0, len(words))})
        todo = [(0, len(words))] if n_blocks else []
        out = []
        while todo:
            a, b = todo.pop()
            used = np.zeros(b - a, bool)
            for x in self.best_first(self.matches(text, at, words, ids, a, b)):
                first, last = x.matched[0], x.matched[-1]
                if used[first - a : last - a + 1].any():
                    continue
                used[first - a : last - a + 1] = True
                end = at[last][1]
                if text.startswith(self.tails[x.template], end):
                    end += len(self.tails[x.template])
                out.append({"license": self.wordings[x.template].name, "start": at[first][0], "end": end, "saving": x.saving, "n_differences": len(x.differ), "differences": x.differ})
            if used.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
                todo += [(a + int(x), a + int(y)) for x, y in edges.reshape(-1, 2)]
        return n_blocks, sorted(out, key=lambda x: x["start"])


FOUND = "array<struct<license: string, start: bigint, end: bigint, saving: double, n_differences: bigint, differences: array<string>>>"


def scan(docs: DataFrame, known: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, candidates (how many blocks), licenses (array of confirmed ones with spans and differences) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known or templates())  # some hundred kB of the package's own texts
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        fields = [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saving", pa.float64()), ("n_differences", pa.int64()), ("differences", pa.list_(pa.string()))]
        for batch in batches:
            found = [scanner.scan(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.struct(fields)))], names=[id_col, "candidates", "licenses"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, candidates bigint, licenses {FOUND}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    exact = F.filter("licenses", lambda x: x["n_differences"] == 0)
    return found.select(
        "doc_id",
        "candidates",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.size(exact).cast("bigint").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
