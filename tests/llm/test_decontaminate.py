"""Decontamination against a brute force over all alignments, with partial and altered passages."""

import random
from itertools import combinations

from pricemill.llm.decontaminate import LEAST_PERCENT, LEAST_TOKENS, SEEDS, contamination, drop_contaminated


def overlaps(a, b):
    """Whether any alignment has a stretch of enough tokens with enough equal ones, of whatever length."""
    for shift in range(-len(b) + 1, len(a)):
        first, last = max(0, shift), min(len(a), len(b) + shift)
        score, before, least = 0, [0], []
        for i in range(first, last):
            score += 100 * (a[i] == b[i - shift]) - LEAST_PERCENT
            before.append(score)
        for end in range(LEAST_TOKENS, len(before)):
            least.append(min(before[end - LEAST_TOKENS], least[-1]) if least else before[0])
            if before[end] >= least[-1]:
                return True
    return False


def most_equal(a, b):
    """The most equal tokens of a stretch of 13 to 25 tokens that is good enough."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [a[i] == b[i - shift] for i in range(max(0, shift), min(len(a), len(b) + shift))]
        for n in range(LEAST_TOKENS, 2 * LEAST_TOKENS):
            best = max([best, *(e for e in (sum(same[s : s + n]) for s in range(len(same) - n + 1)) if 100 * e >= LEAST_PERCENT * n)])
    return best


def found(spark, docs, items):
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} long, text string")
    docs, items = frame(docs, "doc_id"), frame(items, "item_id")
    return {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()}, drop_contaminated(docs, items)


def brute_force(docs, items):
    return {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) if len(t) >= LEAST_TOKENS and overlaps(d, t)}


def test_partial_and_altered_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(rng.choice([13, 15, 18, 25, 40, 60]))] for _ in range(24)]
    docs, planted = [], set()
    for i in range(400):
        text = [word() for _ in range(rng.randint(20, 60))]
        k = rng.randrange(len(items))
        n = rng.choice([m for m in (12, 13, 14, 15, 16, 17, 18, 25, 40, 60) if m <= len(items[k])])
        at = rng.randrange(len(items[k]) - n + 1)
        passage = items[k][at : at + n]
        wrong = rng.randint(0, n // 5 + 1)
        for j in rng.sample(range(n), wrong):
            passage[j] = word()
        text[rng.randrange(len(text)) : 0] = passage
        if n >= LEAST_TOKENS and 100 * (n - wrong) >= LEAST_PERCENT * n:
            planted.add((i, k))
        docs.append(text)
    got, kept = found(spark, docs, items)
    assert planted <= got and got == brute_force(docs, items)
    assert {r.doc_id for r in kept.collect()} == set(range(400)) - {i for i, _ in got}


def test_few_words(spark):
    rng = random.Random(8)
    text = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = [text(rng.randint(10, 40)) for _ in range(12)]
    docs = [text(rng.randint(0, 60)) for _ in range(150)]
    got, _ = found(spark, docs, items)
    assert got == brute_force(docs, items) and 0 < len(got) < len(docs) * len(items)


def test_overlap_is_that_of_the_best_stretch(spark):
    rng = random.Random(9)
    text = lambda n: [rng.choice("abcde") for _ in range(n)]
    items = [text(rng.randint(13, 40)) for _ in range(6)]
    docs = [text(rng.randint(0, 10)) + [w if rng.random() < 0.9 else "x" for w in rng.choice(items)] + text(5) for _ in range(30)]
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    wanted = {(i, k): most_equal(d, t) for i, d in enumerate(docs) for k, t in enumerate(items)}
    assert got == {pair: n for pair, n in wanted.items() if n} and len(got) > 10


def test_every_stretch_holds_a_seed():
    masks = [[i for i, bit in enumerate(mask) if bit == "1"] for mask in SEEDS]
    for n in (13, 15, 20, 25):  # a stretch of another length holds one of these
        for wrong in map(set, combinations(range(n), n // 5)):
            assert any(wrong.isdisjoint(at + i for i in m) for m in masks for at in range(n - m[-1])), (n, wrong)
