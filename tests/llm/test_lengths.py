"""Repeated strings of other lengths than the registered ones, against brute force."""

import random

import brute
import pytest

from tessella.llm import suffix_dedup


def corpus(seed):
    """Texts with shared passages of many lengths, shifted, and with runs of one character."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (60, 130, 220, 400, 1200, 2500)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(50) : len(s) - rng.randrange(50)], text(rng.randrange(30))]
        rows.append((i, " ".join(parts)))
    return [*rows, (90, "x" * 9000), (91, "y" + "x" * 7000), (92, shared[-1] + shared[-1]), (93, None), (94, "")]


@pytest.mark.parametrize("length,short", [(400, 240), (1000, 240), (1000, 700), (5000, 1000), (8192, 8192)])
def test_lengths_against_brute_force(docs, length, short):
    rows = corpus(length)
    found = suffix_dedup.remove_repeats(docs(*rows), length=length, short=short).collect()
    want, again = brute.repeats(rows, length), brute.repeats(rows, short)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    assert {r.doc_id: r.n_repeated for r in found} == {i: x[1] for i, x in again.items()}
    assert any(x[1] for x in want.values())


def test_lengths_out_of_bounds(docs):
    for length, short in ((8193, 400), (300, 240), (400, 200)):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(docs((1, "x")), length=length, short=short)
