"""Hard negatives, the conversation trie and toxicity against plain versions, with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.llm import queries as Q
from quirelight.llm import toxicity as T
from quirelight.llm.conversation_trie import ordered, prefix_trie, rebuilt
from quirelight.llm.hard_negatives import Block, hard_negatives

SF = "/root/testdata/sf0.001"

# --- hard negatives ---------------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, scale=256, k=5, take=5):
    fine = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in fine:
        if i % 10:
            continue
        others = sorted((-dot(v, w), j, z) for j, z, w in fine if j != i and len(w) == len(v))
        for p, j, _ in [o for o in others if o[2] == y][:k]:
            near = [o for o in others if o[2] != y and 80 * -p <= 100 * -o[0] <= 100 * -p][:take]
            out += [(i, j, r + 1, n[1], -p, -n[0]) for r, n in enumerate(near)]
    return sorted(out)


def found_negatives(spark, rows):
    schema = "vec_id long, embedding array<double>, label int, key string, d int, b int, ask int, block string"
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], schema)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).select(cols).collect())


def test_hard_negatives_with_ties_nulls_lengths_and_repeats(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(k, [float(x) for x in centre[k % 4] + 0.3 * rng.normal(size=6)], int(rng.integers(0, 3))) for k in range(150)]
    rows += [(k, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], k % 3) for k in range(150, 190)]  # ties
    rows += [(190, None, 1), (200, [1.0, None], 1), (201, [math.nan] * 6, 1), (202, [math.inf] * 6, 0), (210, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(220, [0.5, 0.25], 0), (221, [0.5, 0.5], 0), (222, [0.5, 0.2], 1), (230, [], 1), (231, [], 1), (232, [], 0)]
    rows += [rows[10], rows[10], (20, rows[30][1], 2)]  # repeated ids, equal and not
    rows += [(240, [0.0] * 6, 0), (250, [-1.0] * 6, 0), (251, [-2.0] * 6, 0), (252, [-3.0] * 6, 1)]
    assert found_negatives(spark, rows) == plain_negatives(rows)
    assert found_negatives(spark, []) == []


def test_hard_negatives_of_large_components_are_exact(spark):
    # all scores fit 64 bits, the bound of eight largest products does not
    big = [(k, [6e5 * (1 + k) if d == k % 3 else 0.0 for d in range(8)], k % 2) for k in range(12)]
    huge = [(k, [2.0**60 if k % 4 == 0 else 0.0, 2.0**-8 * k], k % 2) for k in range(1, 12)] + [(20, [0.0, 2.0**-8 * 7], 0)]
    assert found_negatives(spark, big) == plain_negatives(big)
    assert found_negatives(spark, huge) == plain_negatives(huge)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for d in (1, 5, 8):
        v = rng.integers(-300, 300, size=(200, d)) * rng.integers(0, 2, size=(200, d))
        block = Block.unpacked(Block(np.arange(200), rng.integers(0, 3, 200), v).packed())
        for _ in range(20):
            q = rng.integers(-500, 500, size=d)
            low, high = block.bounds(q, slice(3, 190))
            true = block.v[3:190] @ q
            assert (low <= true).all() and (true <= high).all() and (high - low).mean() < 0.5 * (true.max() - true.min() + 1)


# --- conversations ----------------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x for *_, x in sorted(v)] for c, v in turns.items()}
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        path[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(path[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def found_trie(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x", 7) for r in rows], "conv_id long, turn int, role string, text string, piece int, digest string, pos int")
    out = prefix_trie(*rebuilt(ordered(df), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, family=100, most=5))
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out.collect())


def test_trie_with_copies_long_conversations_nulls_and_ties(spark):
    rng = np.random.default_rng(6)
    word = lambda: "abcdé"[int(rng.integers(0, 3))] * int(rng.integers(0, 3))
    rows = [(int(c), t, "user" if t % 2 else "bot", word()) for c in [*range(0, 12), *range(95, 140), *range(300, 330), -5, -100, -130] for t in range(int(rng.integers(1, 8)))]
    rows += [(c, t, "user", "same opening") for c in range(1000, 1090) for t in range(3)]  # a hot family of copies
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(700)]  # one conversation over many partitions
    rows += [(501, t, "user", f"turn {t % 3}") for t in range(650)]
    rows += [(600, 1, None, None), (600, None, "user", "first"), (600, 1, "user", "b"), (600, 1, "user", "b"), (600, 1, "user", "a"), (None, 0, "user", "lost"), (601, None, None, None)]
    rows += [(700, 0, "a", "bc"), (701, 0, "ab", "c"), (800, 0, "user", "x" * 100_000)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert found_trie(spark, []) == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)  # no base: five turns go
    rows = [(lone, 0, "user", "gone")]
    assert found_trie(spark, rows) == plain_trie(rows) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


# --- toxicity ---------------------------------------------------------------------------------------------------------------------------


def plain_kernel(a, b):
    def shares(word):
        s, out = [T.BEGIN, *word], defaultdict(float)
        for p in combinations(range(len(s)), T.LETTERS):
            if p[-1] - p[0] < T.SPAN:
                out[tuple(s[i] for i in p)] += T.DECAY ** (p[-1] - p[0] - T.LETTERS + 1)
        return out

    x, y = shares(a), shares(b)
    dot = lambda u, v: sum(n * v.get(k, 0) for k, n in u.items())
    return (dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))) ** T.POWER


def test_kernel_is_that_of_all_subsequences():
    words = T.folded(["idiot", "i.d.i.o.t", "idxiot", "IDÍOT!", "stupid", "ababababab", "xy", "clown"])
    assert words[0] == words[1] == words[3]
    marks = [w for w in words if len(w) > 2]
    found = T.Kernel(marks)(words)
    assert np.allclose(found, [[plain_kernel(w, m) for m in marks] for w in words], atol=1e-5)
    assert T.Kernel(marks)([b"\x01", b""]).max() == 0


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(8)
    common = ["".join(rng.choice(list("bdgklmnrst")) + rng.choice(list("aeou")) for _ in range(int(rng.integers(1, 4)))) for _ in range(300)]
    texts, toxic = [], []
    for k in range(300):
        words = [str(w) for w in rng.choice(common, int(rng.integers(5, 120)))]
        if k % 5 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["wretched", "vermin", "filthy"])))
        texts.append(". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + ".")
        toxic.append(int(k % 5 == 0))
    return texts, np.array(toxic)


def test_insults_with_letters_put_in_are_found(labelled):
    texts, toxic = labelled
    m = T.train(texts[:200], toxic[:200])
    found = m.scores(texts[200:]) >= 0.3
    assert found[toxic[200:] == 1].all() and found[toxic[200:] == 0].mean() <= 0.02
    bad = ["you v e r m i n now", "you v.e.r.m.i.n", "VERMÍN", "such wretcched filtthy ones", "filth-y", "a" * 50_000 + " vermin " + "b" * 50_000, "x " * 200_000 + "\n\nvermin"]
    fine = ["", "hello there", "\n\n", "a b c d e", "123 456", "中文 текст", "a" * 70_000]
    assert (m.scores(bad) >= 0.3).all() and (m.scores(fine) < 0.3).all()
    # a text's score does not depend on those it is scored with
    together, alone = m.scores(bad + fine + texts[:20]), np.concatenate([m.scores([t]) for t in bad + fine + texts[:20]])
    assert np.allclose(together, alone)


def test_toxicity_of_tables(spark, labelled):
    texts, toxic = labelled
    docs = [(k, t, "score", 1) for k, t in enumerate(texts)] + [(900, None, "x", 2), (901, "", "x", 2), (None, texts[0], "x", 2), (0, texts[0], "again", 3), (902, " ".join(["ok"] * 600_000) + " vermin", "long", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, held int")
    labels = spark.createDataFrame([(k, int(y), None) for k, y in enumerate(toxic[:200])] + [(0, 0, None), (None, 1, None), (300, 7, None), (301, None, None), (4, 0, None)], "doc_id long, toxic int, text string")
    m = T.fit(df.where("doc_id < 400 or doc_id is null"), labels)
    out = [(r["doc_id"], r["score"]) for r in T.score(df, m, ["doc_id", "held"]).collect()]
    got = dict(out)
    assert len(out) == len(docs) and sum(i == 0 for i, _ in out) == 2
    assert got[900] == got[901] < 0.3 <= got[902]
    assert all(got[k] >= 0.3 for k in range(300) if toxic[k]) and sum(got[k] >= 0.3 for k in range(300) if not toxic[k]) <= 5
    none = T.fit(df, labels.where("toxic = 1"))
    assert {r["score"] for r in T.score(df, none, ["doc_id"]).collect()} == {0.0}
    assert T.score(df.limit(0), m, ["doc_id"]).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_toxicity_on_held_out_rows(spark, sf):
    where = f"/root/testdata/{sf}"
    out = Q.op13_toxicity(spark, where).where("held_out").join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("lang = 'en'").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)
