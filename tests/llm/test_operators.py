"""Each operator against a brute-force version on a small table with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.llm import queries as Q
from quirelight.llm.embedding_dedup import embedding_near_dedup
from quirelight.llm.html_text import extract_text, visible_text
from quirelight.llm.language_id import fit, predict
from quirelight.llm.licenses import rules, scan_licenses
from quirelight.llm.mixing import mix
from quirelight.llm.ngram_join import in_tree, ngram_jaccard_join
from quirelight.llm.packing import WordTokenizer, best_fit, local_search, pack_documents
from quirelight.llm.pii import sanitise
from quirelight.llm.substring_dedup import substring_dedup
from quirelight.llm.topk_search import exact_top_k

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, start int, n int, tok string"


def words(rng, n):
    return " ".join(f"w{rng.integers(0, 400)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    near = base.split()
    out = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, base), (6, base.upper()), (7, base), (7, base)]
    for k in range(8, 20):
        w = list(near)
        w[int(rng.integers(0, 120))] = f"edit{k}"
        out.append((k, " ".join(w)))
    out.append((20, " ".join([words(rng, 40), *near[10:40], words(rng, 30)])))
    out += [(k, words(rng, int(rng.integers(1, 200)))) for k in range(21, 40)]
    out += [(40, words(rng, 30_000)), (41, "\t\n "), (42, "é 中文 " * 9), (None, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 2, "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def closure(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_jaccard_join(docs, texts, none):
    sets = {}
    for i, t in texts:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    least = closure(sets, links)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs.withColumn("text_class", F.lit("clash"))).collect()}
    assert got == {(i, len(s), least[i]) for i, s in sets.items()}
    assert ngram_jaccard_join(none).count() == 0


def test_tree_walk_equals_plain_overlap():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 20))).astype("<u8") for _ in range(30)]
        x = sets[0]
        want = [100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y)) for y in sets]
        assert in_tree(x, len(x), sets, [len(y) for y in sets], 60) == want


def test_substring_dedup(docs, texts, none):
    ws = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts if i is not None]
    least = {}
    for i, w in ws:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    want = []
    for i, w in ws:
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted(map(tuple, substring_dedup(docs).collect())) == sorted(want)
    assert substring_dedup(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in base[k % 6] + rng.normal(size=8) * 0.05], k % 2) for k in range(60)]
    rows += [(60, None, 1), (61, [0.0] * 8, 1), (62, [float("nan")] * 8, 1), (63, rows[0][1], 0), (64, rows[0][1], None), (65, [None] * 8, 0), (66, [], 0), (67, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    ok = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in ok for b in ok if a != b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= 0.98]
    n = defaultdict(int)
    for a, _ in links:
        n[a] += 1
    least = closure([r[0] for r in rows], links)
    want = {(i, n[i], least[i], least[i] == i) for i, _, _ in rows}
    assert {tuple(r) for r in embedding_near_dedup(df).collect()} == want
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=6), 1)]) for k in range(400)] + [(400, None), (401, [float("inf")] * 6), (402, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in rows if x and np.isfinite(x).all()}
    want = set()
    for q in (i for i in v if i % 100 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:10]
        want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in exact_top_k(df, F.col("vec_id") % 100 == 0).collect()} == want
    assert exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_packing_round_trip(docs, texts, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pack_documents(docs, Q._word_bpe).collect()
    by = defaultdict(list)
    for i, t in texts:
        if i is not None:
            ids = np.array([*inner.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            for k in range(0, len(ids), 2048):
                by[i].append((k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in by.items()}
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(n for x in by.values() for _, _, n, _ in x) // 2048) + 2
    assert pack_documents(none, Q._word_bpe).count() == 0


@pytest.mark.parametrize("text", ["Σίσυφος ΟΔΟΣ İstanbul", "it's  don't 123 ４５", "a\x1cb", "<|endoftext|> hi", "中文 日本 😀😀", "K Å İ̇", "x'S 'LL y'all've", "été क़"])
def test_tokenizer_equals_the_library(text):
    import public_tokenizers

    w = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert w.encode([text])[0] == w.whole(text)


def test_local_search_empties_bins():
    lengths = [6, 6, 6, 4, 4, 4]
    assert len(local_search([[0, 3], [1, 4], [2], [5]], lengths, 10)) == 3
    assert sorted(i for b in best_fit(lengths, 10) for i in b) == list(range(6))


def test_personal_data(spark, none):
    card = "4111 1111 1111 1111"
    rows = [(1, f"mail a.b@c-d.org_x, 10.0.0.256 1.2.3.4.5 {card} +1 (743) 555-3824 é😀 z@y.x"), (2, None), (3, ""), (4, "@@@ ++ 1.2.3 " * 50), (4, "a@b.c")]
    rows += [(10 + k, f"secretword filler{k} other{k}x contact boss@corp.example now") for k in range(6)] + [(30 + k, f"plain filler{k} words without anything") for k in range(60)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, spans2 string")
    out = {(r["doc_id"], r["text"]): r for r in sanitise(df).collect()}

    def base(t):
        o = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        o += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        o += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if m[0] == card]
        return o + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for (i, t), r in out.items():
        assert [(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["kind"] != "term"] == base(t), i
    assert "secretword" not in out[10, rows[5][1]]["sanitised"] and "boss" not in out[10, rows[5][1]]["sanitised"]
    assert all(r["sanitised"] == r["text"] for (i, _), r in out.items() if i >= 30)
    assert sanitise(none).count() == 0


def test_licenses(spark, none):
    assert len(rules()) > 200 and all(re.compile(r[3]) for r in rules())
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, "gnu-General PUBLIC license v3; cc by cc by"), (4, "MIT licenses"), (5, "x " * 5000 + "MIT License"), (5, "")]
    out = {(r["doc_id"], r["n_words"]): r for r in scan_licenses(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert out[1, 8]["labels"] == ["apache", "apache-2.0"] and out[1, 8]["places"][0]["word"] == 3
    assert [p["word"] for p in out[3, 9]["places"]] == [0, 5, 7] and out[3, 9]["base_labels"] == ["cc-by", "gpl"]
    assert out[4, 2]["base_labels"] == [] and out[5, 5002]["places"][0]["word"] == 5000
    assert out[2, 0]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in out.values())
    assert scan_licenses(none).count() == 0


def test_language(spark, none):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", Q.fold_of(F.col("doc_id")) == 2)
    model = fit(df.where("not held"))
    got = predict(df, model, ["doc_id", "lang", "held"]).where("held").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, "123 !!"), (3, ""), (4, "a" * 3_000_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in predict(odd, model, ["doc_id"]).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] != "und"
    clash = predict(odd.withColumns({"Score": F.lit("x"), "lang_pred": F.lit(1)}), model, ["doc_id", "Score", "lang_pred"])
    assert clash.columns == ["doc_id", "lang_pred", "score", "bits_per_byte"] and clash.count() == 4
    assert predict(none, fit(none), ["doc_id"]).count() == 0
    assert predict(odd, fit(none), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_html(spark):
    page = "<head><title>t</title></head><h1>A &amp; B</h1><p>x <b>y</b><br>z<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>h<th>wide one<tr><td>cell<td>v</table><div hidden>no</div><script>1<2</script><pre> k\n  l</pre>"
    assert visible_text(page) == "A & B\n\nx y\nz\n\n- a\n- b\n  1. c\n\nh    | wide one\ncell | v\n\n k\n  l"
    assert visible_text("<div>" * 20_000 + "deep") == "deep"
    for broken in ("<", "<a href=\"x", "</p></p>", "<!-- x", "<td>x", "a < b > c", "&#xD800;"):
        visible_text(broken)
    got = extract_text(spark.createDataFrame([(1, None, "u"), (2, "", "u"), (2, "<p>x", "u")], "page_id long, html string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (2, ""), (2, "x")]


def test_mixing(spark, docs, none):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = mix(df, budget=0.5, power=0.5).toPandas()
    mass = out["n_tokens"] * out["weight"] / out["n_tokens"].sum()
    tokens = out.groupby("lang")["n_tokens"].sum() ** 0.5
    want = tokens / tokens.sum()
    assert np.allclose(mass.groupby(out["lang"]).sum(), want, atol=0.02)
    assert abs((out["n_tokens"] * out["probability"]).sum() / out["n_tokens"].sum() - 0.5) < 0.05
    assert mix(docs).count() == docs.where("doc_id is not null").count() and mix(none).count() == 0


def test_code_lengths_are_those_of_a_plain_walk():
    from quirelight.llm.language_id import ORDER, SYMBOLS, Tree, grams, suffixes

    rng = np.random.default_rng(4)
    s = (97 + rng.integers(0, 5, 400)).astype(np.uint8)
    counted = defaultdict(int)
    padded = bytes(32 for _ in range(ORDER)) + s.tobytes()
    for k in range(len(s)):
        counted[padded[k : k + ORDER + 1]] += 1
    g, c = np.unique(grams(s), return_counts=True)
    assert {int(x).to_bytes(ORDER + 1, "big"): n for x, n in zip(g, c.tolist())} == counted

    def plain(context, symbol):
        cost = 0.0
        for order in range(ORDER, -1, -1):
            seen = defaultdict(int)
            for x, n in counted.items():
                if x[ORDER - order : ORDER] == context[ORDER - order :]:
                    seen[x[ORDER]] += n
            total, kinds = sum(seen.values()), len(seen)
            if seen[symbol] > 0:
                return cost - np.log2(seen[symbol] / (total + kinds))
            if kinds:
                cost -= np.log2(kinds / (total + kinds))
        return cost + np.log2(SYMBOLS)

    some = [bytes(x) for x in np.unique(97 + rng.integers(0, 7, (100, ORDER + 1)).astype(np.uint8), axis=0)]
    got = Tree(g, c).bits(suffixes(np.array([int.from_bytes(x, "big") for x in some], np.uint64)))
    assert np.allclose(got, [plain(x[:ORDER], x[ORDER]) for x in some], atol=1e-9)


def test_language_sample_is_bounded_and_independent_of_partitions(spark):
    from quirelight.llm.language_id import _sample

    rng = np.random.default_rng(6)
    rows = [("en", words(rng, int(rng.integers(1, 60)))) for _ in range(400)] + [("en", "copy of one text")] * 500
    rows += [("de", "kurz"), ("de", "x" * 90_000), ("fr", "y" * 50_000), ("fr", "z" * 40_000)]
    want = None
    for parts in (1, 7):
        got = sorted(map(tuple, _sample(spark.createDataFrame(rows, "lang string, text string").repartition(parts), 16_000).collect()))
        assert want is None or got == want
        want = got
    size = sum(len(t) for lang, t in want if lang == "en")
    assert 15_000 <= size <= 16_000 and len(set(want)) == len(want)
    assert [t for lang, t in want if lang == "de"] == ["kurz"] and len([t for lang, t in want if lang == "fr"]) == 1


def test_mixing_targets_and_clashing_names(spark):
    rows = [(k, "w " * (5 + k % 7), "en" if k % 3 else "de", ["a", "b", None, "\0"][k % 4], 1.5, "x", k // 4 % 2) for k in range(400)]
    df = spark.createDataFrame(rows + [(None, "w", "en", "a", 1.0, "x", 0), (401, None, "en", "a", 1.0, "x", 0)], "doc_id long, text string, lang string, source string, Weight double, probability string, topic int")
    share = spark.createDataFrame([("a", 0.5), ("b", 0.2), (None, 0.2), ("\0", 0.1), ("gone", 9.0)], "source string, share double")
    out = mix(df, budget=0.3, langs={"en": 0.5, "de": 0.5}, topics={"0": 0.6, "1": 0.4}, sources=share, topic=F.col("topic").cast("string"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_tokens", "topic", "weight", "probability", "kept", "target_gap"]
    got = out.toPandas()
    assert len(got) == 401 and got["target_gap"].max() < 1e-4
    mass = got["n_tokens"] * got["probability"] / (0.3 * got["n_tokens"].sum())
    assert np.allclose([mass[got["lang"] == x].sum() for x in ("en", "de")], 0.5, atol=1e-3)
    assert np.allclose([mass[got["topic"] == x].sum() for x in ("0", "1")], [0.6, 0.4], atol=1e-3)
    assert np.allclose([mass[got["source"] == "a"].sum(), mass[got["source"].isna()].sum(), mass[got["source"] == "\0"].sum()], [0.5 / 1, 0.2, 0.1], atol=1e-3)


def test_large_components_give_exact_ranks_or_an_error(spark):
    rows = [(0, [float(1 << 20), 1.0]), (1, [float(1 << 17), 3.0]), (2, [float(1 << 17), 2.0]), (3, [-float(1 << 17), 0.0]), (3, [float(1 << 16), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    q = [1 << 30, 1024]
    assert got == [(0, k, i, q[0] * int(1024 * v[0]) + q[1] * int(1024 * v[1])) for k, (i, v) in enumerate([rows[1], rows[2], rows[4], rows[3]], 1)]
    with pytest.raises(Exception, match="64 bits"):
        exact_top_k(spark.createDataFrame([(0, [1e17]), (1, [1e9])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_that_repeat_an_id_count_for_themselves(spark, kind):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [2.0, 0.0], 0), (3, [-0.0, 3.0], 0), (3, [0.0, 3.0], 0), (4, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, kept boolean, tile string")
    got = sorted(map(tuple, embedding_near_dedup(df).collect()))
    assert [r[:2] for r in got] == [(1, 1), (1, 2), (2, 1), (3, 2), (3, 2), (4, 0)]
    assert [r[2] for r in got] == [1, 1, 1, 1, 1, 4]


def test_top_k_of_large_components_is_exact(spark):
    """Every score fits 64 bits, the product of the largest components and the length does not."""
    one = lambda d: [6e5 if k == d else 0.0 for k in range(64)]
    rows = [(0, one(0)), (1, one(0)), (2, one(1)), (3, [-x for x in one(0)])]
    out = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2)
    top = int(6e5 * 1024) ** 2
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 1, top), (0, 2, 2, 0)]
