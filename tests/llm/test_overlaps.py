"""Benchmark overlaps against brute force over all stretches."""

import numpy as np
import pytest

from threadloom.llm import decontaminate


def counts(equal, similarity, least):
    total = np.r_[0, np.cumsum(equal)]
    return any(total[e] - total[s] >= max(least, similarity * (e - s) - 1e-9) for s in range(len(equal)) for e in range(s + 1, len(equal) + 1))


@pytest.mark.parametrize("similarity, least", [(0.8, 10), (0.8, 5), (0.7, 12), (0.9, 8)])
def test_every_stretch_that_counts_is_found(similarity, least):
    rng = np.random.default_rng(8)
    items, docs, expected = [], [], set()
    for k in range(600):
        n = int(rng.integers(10, 61))
        words = [f"q{k}x{j}" for j in range(n)]
        equal = rng.random(n) >= rng.uniform(0.01, 0.3)
        if k % 6 == 0:
            equal = np.arange(n) % 5 != k // 6 % 5
        if k % 6 == 1:
            equal = np.arange(n) % 4 != 3
        items.append((k, " ".join(words)))
        docs.append(" ".join(["before"] * 5 + [w if e else f"z{j}" for j, (w, e) in enumerate(zip(words, equal, strict=True))] + ["after"] * 5))
        if counts(equal, similarity, min(least, n)):
            expected.add(k)
    block = decontaminate.build_block(items, 5, decontaminate.sure_masks(similarity, least))
    found = decontaminate.overlaps(block, [decontaminate.word_hashes(d, {}) for d in docs], similarity, least)
    assert {d for d, *_ in found} == expected and 100 < len(expected) < 600
    assert all(d == i and matched >= max(min(least, len(items[i][1].split())), similarity * n - 1e-9) for d, i, _, n, matched in found)


def test_the_rule_has_one_spaced_mask():
    assert decontaminate.sure_masks(0.8, 10) == ["11011"]
    assert all("0" in m for s, n in ((0.8, 10), (0.8, 5), (0.7, 12), (0.9, 8), (1.0, 10)) for m in decontaminate.sure_masks(s, n))


def test_a_mask_fits_every_stretch_of_few_words():
    for similarity, least in ((0.8, 4), (0.7, 5), (0.9, 6), (0.75, 3)):
        (mask,) = decontaminate.sure_masks(similarity, least)
        for n in range(least, 15):
            for code in range(1 << n):
                equal = [code >> k & 1 for k in range(n)]
                if sum(equal) >= max(least, similarity * n - 1e-9):
                    assert any(all(e for e, m in zip(equal[k:], mask) if m == "1") for k in range(n - len(mask) + 1)), (mask, equal)


def test_one_word_many_times():
    import time

    block = decontaminate.build_block([(1, "word " * 30), (2, "other words of an item " * 4)], 5, decontaminate.sure_masks(0.8, 10))
    start = time.perf_counter()
    found = decontaminate.overlaps(block, [decontaminate.word_hashes("word " * 40_000, {}), decontaminate.word_hashes("x " * 9 + "word " * 29 + "y", {})], 0.8, 10)
    assert found == [(0, 0, 0, 30, 30), (1, 0, 9, 29, 29)] and time.perf_counter() - start < 5


def test_the_earliest_of_equal_stretches_is_kept():
    item = " ".join(f"w{k}" for k in range(20))
    block = decontaminate.build_block([(1, item)], 5, decontaminate.sure_masks(0.8, 10))
    first = item.replace("w19", "z")
    assert decontaminate.overlaps(block, [decontaminate.word_hashes(f"a b {first} c {item} d {item}", {})], 0.8, 10) == [(0, 0, 23, 20, 20)]
    assert decontaminate.overlaps(block, [decontaminate.word_hashes(f"a b {first} c {first}", {})], 0.8, 10) == [(0, 0, 2, 19, 19)]
