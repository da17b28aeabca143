"""Near-duplicates against all pairs, on groups of copies and their variants."""

import random

import pytest

from pricemill.llm import near_dedup
from pricemill.llm.components import components
from pricemill.llm.near_dedup import near_duplicates


def brute(rows, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        words = [w for w in text.translate(lower).replace("\n", " ").replace("\t", " ").split(" ") if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    for size, changes in ((60, 6), (30, 2), (25, 12), (10, 0), (3, 1)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own).upper() if i % 7 == 0 else "\t ".join(own)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent, block", [(85, 4096), (80, 4096), (85, 8)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = variants()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}}
