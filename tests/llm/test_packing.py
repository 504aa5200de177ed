"""Plans of packing against plain best-fit; several secrets in one run."""

import collections
import random

import pytest

from forecourt.llm import packing, secrets


def best_fit(counts, capacity):
    gaps = []
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            k = min((k for k, g in enumerate(gaps) if g >= x), key=lambda k: gaps[k], default=None)
            if k is None:
                gaps.append(capacity - x)
            else:
                gaps[k] -= x
    return len(gaps)


def histogram(seed, capacity):
    rng = random.Random(seed)
    low, high = [(1, capacity), (capacity // 5, capacity), (1, capacity // 3), (capacity // 4, capacity // 2)][seed % 4]
    return {rng.randint(low, high): rng.randint(1, rng.choice([2, 8])) for _ in range(rng.choice([3, 40, 150, 300]))}


@pytest.mark.parametrize("seed", range(50))
def test_never_more_sequences_than_best_fit(seed):
    counts = histogram(seed, 2048)
    plan, placed = packing.plan_packing(counts, 2048), collections.Counter()
    for many, items in plan:
        assert many > 0 and sum(x * k for x, k in items) <= 2048
        for x, k in items:
            placed[x] += many * k
    assert placed == collections.Counter(counts)
    assert sum(many for many, _ in plan) <= best_fit(counts, 2048)


def test_complements_of_one_two_and_three_lengths():
    plan = packing.complements({90: 3, 10: 1, 6: 1, 4: 1, 5: 1, 3: 1, 2: 1}, 100)
    assert [(m, [x for x, k in items for _ in range(k)]) for m, items in plan] == [(1, [90, 10]), (1, [90, 6, 4]), (1, [90, 5, 3, 2])]


@pytest.mark.parametrize("sign", [".", "/", "=", "+"])
def test_all_secrets_of_a_run_are_found(sign):
    rng = random.Random(5)
    token = lambda: "sk_" + "".join(rng.choice("abcdef0123456789XYZ") for _ in range(20))
    words = [f"{a}-{b}" for a in ("some-ordinary", "example", "another-thing") for b in ("word-with-more", "entry-of-a-list", "host2-name")] * 5
    grammar = secrets.Grammar(secrets.build({"assign": [token() for _ in range(400)]}, words))
    for n in (2, 3):
        own = [token() for _ in range(n)]
        text = f"see {sign.join(own)} there"
        covered = set()
        for a, b, _ in grammar.spans(text, []):
            covered |= set(range(a, b))
        assert all(set(range(text.index(x), text.index(x) + len(x))) <= covered for x in own)
