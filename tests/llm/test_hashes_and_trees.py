"""Word hashes on words with structure, prefix trees against plain overlap, and links that only the second round of the join finds."""

from __future__ import annotations

import numpy as np
import pytest

from quirelight.llm.ngram_join import ngram_jaccard_join
from quirelight.llm.prefix_tree import PrefixTree
from quirelight.llm.substring_dedup import substring_dedup
from quirelight.llm.words import Words


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1, 8, 9, 1024, 1025, 4096, 8192])
def test_words_that_cancel_in_polynomials_differ(n):
    w = Words([thue_morse(n).encode(), thue_morse(n, 1).encode(), ("x " + thue_morse(n)).encode()])
    for which in (0, 1):
        a, b, _, again = w.hashes(which)
        assert a == again and a != b


def test_thue_morse_words_are_not_taken_for_each_other(spark):
    for n in (1024, 8192):
        rest = " ".join(f"w{k}" for k in range(12))
        rows = [(1, f"{thue_morse(n)} {rest}"), (2, f"{thue_morse(n, 1)} {rest}"), (3, f"{thue_morse(n)} {rest} z")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup(docs).collect()} == {(1, 0), (2, 0), (3, 13)}
        short = spark.createDataFrame([(1, thue_morse(n)), (2, thue_morse(n, 1)), (3, thue_morse(n).upper())], "doc_id long, text string")
        assert {(r["doc_id"], r["component_id"]) for r in ngram_jaccard_join(short).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_one_tree_serves_all_probes():
    rng = np.random.default_rng(8)
    for percent in (40, 75, 100):
        sets = [np.unique(rng.integers(0, 25, rng.integers(0, 22))).astype("<u8") for _ in range(60)]
        sets += [sets[3], sets[3][:2], np.empty(0, "<u8")]
        sizes = [len(y) + int(rng.integers(0, 3)) for y in sets]
        tree = PrefixTree(sets, sizes, percent)
        for x, nx in zip(sets, sizes):
            want = [i for i, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= percent * (nx + sizes[i] - len(np.intersect1d(x, y)))]
            assert sorted(tree.similar(x, nx)) == want
            some = list(range(0, len(sets), 3))
            assert sorted(tree.similar(x, nx, some)) == [i for i in want if i % 3 == 0]


def test_chain_of_links_between_components(spark):
    """Windows of one long text: each is linked with its neighbours only, and all are one component; a hot group of near copies beside it."""
    base = [f"t{k}" for k in range(1400)]
    rows = [(k, " ".join(base[4 * k : 4 * k + 60])) for k in range(300)]
    hot = [f"h{k}" for k in range(80)]
    rows += [(1000 + k, " ".join([*hot[:40], f"edit{k}", *hot[41:]])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(docs).collect()}
    assert all(got[k] == 0 for k in range(300)) and all(got[1000 + k] == 1000 for k in range(600))
