"""corpus_pipeline.run() against a plain version of its five stages."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from quirelight.llm import pii
from quirelight.llm.language_id import ORDER, SYMBOL, SYMBOLS, fit
from quirelight.llm.mixing import ended, filled, step_of

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def language(rows, model):
    """Prediction by partial matching from dictionaries of contexts."""
    trees = []
    for grams, counts in model.counted:
        tree = defaultdict(Counter)
        for g, c in zip(grams.tolist(), counts.tolist()):
            s = tuple(g.to_bytes(ORDER + 1, "big"))
            for k in range(ORDER + 1):
                tree[s[k:ORDER]][s[ORDER]] += c
        trees.append((tree, {}))

    def bits(tree, held, s):
        if s not in held:
            cost = 0.0
            for k in range(ORDER + 1):
                seen = tree.get(s[k:ORDER], {})
                total, kinds = sum(seen.values()), len(seen)
                if seen.get(s[ORDER]):
                    cost -= math.log2(seen[s[ORDER]] / (total + kinds))
                    break
                cost -= math.log2(kinds / (total + kinds)) if kinds else 0.0
            else:
                cost += math.log2(SYMBOLS)
            held[s] = cost
        return held[s]

    for i, text, _, source in rows:
        if regex.search(r"\p{L}", text or ""):
            s = (32,) * ORDER + tuple(SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist())
            costs = [sum(bits(tree, held, s[k : k + ORDER + 1]) for k in range(len(s) - ORDER)) for tree, held in trees]
            if min(costs) / len(text.encode()) < math.log2(SYMBOLS):
                yield i, text, model.langs[costs.index(min(costs))], source


def near_duplicates(rows):
    sets = {}
    kept = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(r[1].translate({c: c + 32 for c in range(65, 91)}).encode()).hexdigest()):
        kept.setdefault(r[0], r)
    for i, text, *_ in kept.values():
        w = re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return [r for r in kept.values() if least[r[0]] == r[0]]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def personal_data(rows, places=None):
    """The sanitised rows; places gathers (id, base matches by kind, matches of terms)."""
    places = [] if places is None else places

    def base(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return out + [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]

    n, docs = len(rows), Counter(r[1] for r in rows)
    entities = {t: {f"{k}:{m[0].lower()}" for k, m in base(t)} for t in docs}
    words = {t: set(regex.findall(pii.WORD, t.lower())) for t in docs}
    n_e, n_p, df = Counter(), Counter(), Counter()
    for t, k in docs.items():
        df.update(dict.fromkeys(words[t], k))
        for e in entities[t]:
            n_e[e] += k
            n_p.update({(e, w): k for w in words[t]})
    speaks = Counter()
    for t in docs:
        for k, m in base(t):
            e = f"{k}:{m[0].lower()}"
            near = t[max(0, m.start() - pii.NEAR) : m.start()] + " " + t[m.end() : m.end() + pii.NEAR]
            for w in regex.findall(rf"\p{{Lu}}\p{{L}}{{{pii.TERM - 1},}}+", near):
                speaks[e, w.lower()] = max(speaks[e, w.lower()], pii.BESIDE)
            for w in regex.findall(pii.WORD, e.split(":", 1)[1]):
                speaks[e, w] = pii.PART
    # entities of the same texts share what speaks for their terms
    where = defaultdict(set)
    for t in docs:
        for e in entities[t]:
            where[e].add(t)
    shared = Counter()
    for (e, w), k in speaks.items():
        shared[frozenset(where[e]), w] = max(shared[frozenset(where[e]), w], k)
    share = {}
    for (e, w), c in n_p.items():
        if n_e[e] < n:
            more = shared[frozenset(where[e]), w]
            m, zz = df[w] + more, pii.Z**2
            p = (c + more) / m
            low = (p + zz / 2 / m - pii.Z * math.sqrt(p * (1 - p) / m + zz / 4 / m**2)) / (1 + zz / m)
            if low >= pii.CERTAIN and 1 + math.log2(p) / -math.log2(n_e[e] / n) >= pii.GENERALISE:
                share[e, w] = 1 + math.log2(low) / -math.log2(n_e[e] / n)
    bound = 2 * max(n_e.values(), default=0) + pii.PART
    wide = {w[: pii.STEM] for w, k in df.items() if k > bound}

    def label(w, lost):
        return "" if lost >= pii.REMOVE else f"[{w[: pii.STEM]}*]" if w[: pii.STEM] in wide else "[TERM]"

    for i, t, lang, source in rows:
        spans = [(m.start(), m.end(), f"[{k.upper()}]") for k, m in base(t)]
        if spans:
            lost = {w: max(share.get((e, w), -math.inf) for e in entities[t]) for w in words[t]}
            more = [m for m in regex.finditer(pii.WORD, t) if lost.get(m[0].lower(), -math.inf) > -math.inf and not any(a < m.end() and m.start() < b for a, b, _ in spans)]
            spans += [(m.start(), m.end(), label(m[0].lower(), lost[m[0].lower()])) for m in more]
        places.append((i, base(t), more if spans else []))
        at, out = 0, ""
        for a, b, new in sorted(spans):
            if a >= at:
                out += t[at:a] + new
            at = max(at, b)
        yield i, out + t[at:], lang, source


def mixture(rows, budget, power=0.7):
    def topic(t):
        return "tables" if " | " in t else "symbols" if re.search(r"[*$%&#]{3}", t) else "notes" if len(t) < 400 else "books" if len(t) > 8000 else "prose"

    cells = Counter()
    for _, t, lang, source in rows:
        cells[source, lang, topic(t)] += len(re.findall(WORD, t))
    cells = {k: v for k, v in cells.items() if v}
    amount = budget * sum(cells.values())
    want, factor = [], []
    for side in range(3):
        mass = Counter()
        for k, v in cells.items():
            mass[k[side]] += v
        want.append(filled({k: v**power for k, v in mass.items()}, dict(mass), amount))
        factor.append(dict.fromkeys(mass, 1.0))
        assert abs(sum(want[-1].values()) - amount) < 1e-6 * amount and all(want[-1][k] <= mass[k] for k in mass)

    def solve(source):
        """The source's factor by bisection."""
        mine = [(v, factor[1][k[1]] * factor[2][k[2]]) for k, v in cells.items() if k[0] == source]
        low, high = 0.0, 1 / min(r for _, r in mine)
        for _ in range(200):
            f = (low + high) / 2
            low, high = (f, high) if sum(v * min(1.0, f * r) for v, r in mine) < want[0][source] else (low, f)
        return high

    gaps = []
    while True:
        factor[0] = {k: solve(k) for k in factor[0]}
        p = {k: min(1.0, factor[0][k[0]] * factor[1][k[1]] * factor[2][k[2]]) for k in cells}
        whole, part = Counter(), Counter()
        for k, v in cells.items():
            (whole if p[k] >= 1 - 1e-12 else part)[k[1], k[2]] += v * p[k]
        side = lambda c, d, x: sum(v for k, v in c.items() if k[d] == x)
        gaps.append(max(abs(side(whole, d, x) + side(part, d, x) - w) for d in (0, 1) for x, w in want[d + 1].items()) / amount)
        if ended(gaps):
            break
        step = {x: step_of(w, side(whole, 0, x), side(part, 0, x)) for x, w in want[1].items()}
        part = {k: v * step[k[0]] for k, v in part.items()}
        factor[1] = {x: f * step[x] for x, f in factor[1].items()}
        factor[2] = {x: f * step_of(want[2][x], side(whole, 1, x), side(part, 1, x)) for x, f in factor[2].items()}
    for r in rows:
        u = xxhash.xxh64_intdigest(struct.pack("<i", 0), xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)) % (1 << 53) / (1 << 53)
        key = r[3], r[2], topic(r[1])
        yield r, p.get(key, budget), u < p.get(key, budget)


def test_personal_data_equals_a_plain_version(spark):
    from quirelight.llm import queries as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", "", "") for r in docs.collect()]
    places = []
    text = {r[0]: r[1] for r in personal_data(rows, places)}
    want = set()
    for i, base, more in places:
        spans = [f"{k}:{m.start()}:{m.end()}" for kind in ("email", "ip", "card", "phone") for k, m in base if k == kind]
        counts = [sum(k == kind for k, _ in base) for kind in ("email", "ip", "card", "phone")]
        want.add((i, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans + [f"term:{m.start()}:{m.end()}" for m in more])))
    assert any("term:" in x[-1] for x in want)
    assert {tuple(r) for r in Q.op4_pii(spark, SF).collect()} == want
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs.select("doc_id", "text")).collect()}
    assert got == text


def test_mixing_equals_a_plain_version(spark):
    from quirelight.llm import queries as Q

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = {r[0]: (p, kept) for r, p, kept in mixture([(i, t or "", lang, source) for i, t, lang, source in rows], 0.5)}
    got = Q.op9_source_mixing(spark, SF).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        assert abs(r.probability - want[r.doc_id][0]) < 1e-6 and r.kept == want[r.doc_id][1] and abs(r.weight * 0.5 - r.probability) < 1e-12
    # the sample's own marginals are the targets
    expected, total = got["n_tokens"] * got["probability"], got["n_tokens"].sum()
    for side in ("source", "lang", "topic"):
        tokens = got.groupby(side)["n_tokens"].sum()
        target = filled((tokens**0.7).to_dict(), tokens.to_dict(), 0.5 * total)
        for value, mass in expected.groupby(got[side]).sum().items():
            assert abs(mass - target[value]) < 1e-3 * 0.5 * total


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(1)
    odd = [first.withColumns({"doc_id": F.lit(9_000_000 + k).cast("long"), "text": F.lit(t).cast("string")}) for k, t in enumerate([None, "", "12 34", "Hello"])]
    odd += [first.withColumn("doc_id", F.lit(9_000_010).cast("long")), first]
    for x in odd:
        docs = docs.unionByName(x)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    rows = [r for r, _, kept in mixture(list(personal_data(near_duplicates(list(language(rows, fit(docs)))))), P.BUDGET) if kept]
    inner = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows:
        ids = np.array([*inner.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        stops = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *stops[:-1]] and stops[-1] <= 2048
    assert len(bins) <= -(-sum(x[3] for x in want) // 2048) + 2


def test_awkward_tables_pass_all_stages(spark, tmp_path):
    """Empty tables, rows without an id, repeated ids and columns that are named as the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "rows", "__rows", "__class", "spans", "Sanitised", "weight", "probability", "kept", "topic", "n_tokens", "lang_pred", "text_class", "component_id", "cls"]
    wide = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    long = docs.orderBy(F.desc("n_chars")).limit(1).first()
    clean = wide.where(F.col("doc_id") == long["doc_id"])
    table = wide.unionByName(clean.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(clean).unionByName(clean)
    for k, docs in enumerate((table, table.limit(0))):
        for name, step in P.STAGES[:-1]:
            out = step(spark, docs, str(tmp_path))
            assert out.columns == table.columns, name
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert docs.where("doc_id is not null").where("score <> concat('score', doc_id) or kept <> concat('kept', doc_id) or spans <> concat('spans', doc_id) or `__class` <> concat('__class', doc_id)").isEmpty()
            if k == 0 and name == "near_duplicates":
                assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
        rows = P.packing(spark, docs, str(tmp_path))
        assert rows.isEmpty() == (k == 1)
        # rows without an id go where documents are drawn by it, and nowhere before
        assert docs.where("doc_id is null").isEmpty()
