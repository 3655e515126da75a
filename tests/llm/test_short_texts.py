"""Links of short texts whose shared shingles are hot, against brute force."""

import random

import brute
import pytest

from textloom.llm import chosen_path


def hot(length, n):
    """A text, and n texts that each add a word of their own to it."""
    base = [f"h{length}x{i}" for i in range(length)]
    return [" ".join(base), *(" ".join([*base, f"own{length}n{i}"]) for i in range(n))]


@pytest.mark.parametrize("length", [8, 9, 10, 12])
def test_no_link_of_a_hot_short_text_is_lost(spark, length):
    texts, rng = hot(length, 300), random.Random(length)
    texts += [" ".join(rng.choice("a b c".split()) for _ in range(rng.randint(1, 26))) for _ in range(60)]
    rows = list(enumerate(dict.fromkeys(texts)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.classes(rows)
    assert got == want
    assert want[0] == (0, 300)
