
from __future__ import annotations

import itertools
import random
import re
import re._parser as parser

from quirelight.llm.licenses import GATE, rules, scan_licenses
from quirelight.llm.packing import local_search
from quirelight.llm.pii import sanitise


def test_terms_are_protected_on_evidence(spark):
    lone = "hapaxia common words write to Lonegan at lonegan@corp.example today"
    copy = "groupword common words write to group@corp.example today"
    rows = [(1, lone)] + [(2, copy)] * 30 + [(100 + k, f"common words write today filler{k}") for k in range(120)]
    out = {r["doc_id"]: r["sanitised"] for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # seen once beside an entity, a word proves nothing; the name in the address does, and so do thirty documents
    assert out[1] == "hapaxia common words write to [TERM] at [EMAIL] today"
    assert out[2] == "[TERM] common words write to [EMAIL] today"
    assert out[100] == rows[-120][1]


def planted(seed=2, people=40):
    """A corpus in which people have addresses, names and by-names, and the terms that give them away."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(400)]
    rows, secret = [], {}
    for _ in range(people):
        name, byname = word() + "ov", word() + "ix"
        mail = f"{name}.{rng.choice(common)}@{rng.choice(common)}.example"
        for k in range(rng.randint(1, 12)):
            text = rng.choices(common, k=60) + [word() + word() for _ in range(5)]  # rare words and typos
            rng.shuffle(text)
            text[10:10] = [byname]
            text[30:30] = ["ask", name.capitalize(), mail]
            rows.append(" ".join(text))
            secret.setdefault(mail, (name, byname, []))[2].append(len(rows) - 1)
    rows += [" ".join(rng.choices(common, k=60) + [word() + word() for _ in range(5)]) for _ in range(1500)]
    return rows, secret


def test_planted_names_are_found_and_rare_words_stay(spark):
    rows, secret = planted()
    out = {r["doc_id"]: r for r in sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    wanted, found, words = set(), set(), 0
    for name, byname, ids in secret.values():
        wanted |= {(i, name) for i in ids}
        if len(ids) >= 6:  # fewer do not prove a by-name
            wanted |= {(i, byname) for i in ids}
    for i, r in out.items():
        spans = [r["text"][s["start"] : s["stop"]].lower() for s in r["spans"] if s["kind"] == "term"]
        found |= {(i, w) for w in spans}
        words += len(r["text"].split()) if "@" in rows[i] else 0
    # by-names of four or five documents may be found as well
    fair = {(i, w) for name, byname, ids in secret.values() for i in ids for w in (name, byname)}
    recall, precision = len(found & wanted) / len(wanted), len(found & fair) / len(found)
    print(f"recall {recall:.3f}, precision {precision:.3f}, {len(found)} of {words} words")
    assert recall >= 0.95 and precision >= 0.95


def phrases(tree):
    """Texts that take each alternative of a parsed regex; a repeated part is left out or taken once."""
    out = [""]
    for op, av in tree:
        match str(op):
            case "LITERAL":
                more = [chr(av)]
            case "IN":
                more = [chr(x[1]) if str(x[0]) == "LITERAL" else chr(x[1][0]) for x in av]
            case "SUBPATTERN":
                more = phrases(av[3])
            case "BRANCH":
                more = [x for branch in av[1] for x in phrases(branch)]
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                more = ([""] if av[0] == 0 else []) + phrases(av[2])
            case "ANY":
                more = ["x"]
            case "ASSERT_NOT":
                more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_alternative_of_a_license_rule_opens_its_gates():
    for label, _, keywords, regex in rules():
        for x in phrases(parser.parse(regex)):
            assert any(w in f" {x} " for w in keywords.split("|")) and re.search(GATE, f" {x} "), (label, x)


def test_licenses_by_full_name_and_long_holders(spark):
    end = "may be used to endorse or promote products derived from this software without specific prior written permission."
    holder = "the Institute of Applied Examples and Very Long Names of the University of Somewhere in the Middle nor the names of its contributors "
    rows = [(1, "BSD Zero Clause License"), (2, "Do What The Fuck You Want To Public License"), (3, f"Neither the name of {holder}{end}"), (4, f"Neither the name of {'very long ' * 40_000}{end}"), (5, f"{'neither the name of x ' * 5_000}{end}")]
    out = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "0bsd" in out[1] and "wtfpl" in out[2]
    assert all("bsd-3-clause" in out[k] for k in (3, 4, 5))


def improving(bins, lengths, size):
    """A step that local_search() must not leave, by trying all."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, x in enumerate(bins):
        for b, y in enumerate(bins):
            for give in [(), *itertools.combinations(x, 1), *itertools.combinations(x, 2)] if a != b else []:
                for take in [(), *itertools.combinations(y, 1)]:
                    d = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                    if max(fill[b] + d, fill[a] - d) <= size and d * (fill[b] - fill[a] + d) > 0:
                        return a, b, give, take
    return None


def test_local_search_leaves_no_step():
    rng = random.Random(3)
    for size in (12, 30, 64):
        for _ in range(20):
            lengths = [rng.randint(1, size - 1) for _ in range(60)]
            bins = local_search([[i] for i in range(60)], lengths, size)
            assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= size for b in bins)
            assert improving(bins, lengths, size) is None


def test_local_search_reaches_beyond_the_fullest_bins():
    # the bin of 4 fits only the bin of 6, which 100 fuller ones precede
    lengths = [9] * 100 + [6, 4]
    assert len(local_search([[i] for i in range(102)], lengths, 10)) == 101


def test_many_entities_in_one_text_take_linear_time(spark):
    import time

    text = " ".join(f"person{k} wrote from user{k}@corp{k}.example +49 30 {1000000 + k}" for k in range(16_000))
    rows = [(1, text), (2, "plain words"), (3, "a@b.example é\ue000word longwordx")]
    start = time.time()
    out = {r["doc_id"]: r for r in sanitise(spark.createDataFrame([(*r, "old", "x") for r in rows], "doc_id long, text string, Spans string, note string")).collect()}
    assert time.time() - start < 60
    kinds = [s["kind"] for s in out[1]["spans"]]
    assert kinds.count("email") == 16_000 and kinds.count("phone") == 16_000 and "@" not in out[1]["sanitised"]
    assert out[1].asDict().keys() == {"doc_id", "text", "spans", "sanitised", "note"}


def test_spread_join_above_and_below_its_share(spark):
    """A key of a third of all rows is broadcast, 300 small ones are not; together the join is whole."""
    from pyspark.sql import functions as F

    from quirelight.llm.blocks import of_members
    from quirelight.llm.skew import SHARES, spread_join

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 301).alias("key"), "id")
    table = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("k"), "key")).where("key <> 7")
    often = table.where(F.col("n") * SHARES > 9000)
    assert often.count() == 1 and table.count() > SHARES
    got = spread_join(rows, table, "key", "n")
    want = rows.join(table, "key")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()
    assert spread_join(rows.limit(0), table.limit(0), "key", "n").isEmpty()
    members = rows.select(F.col("id").alias("doc_id"), F.col("key").cast("string").alias("cls"))
    classes = table.select(F.col("key").cast("string").alias("cls"), "name")
    out = of_members(spark, members, classes)
    assert out.columns == ["cls", "doc_id", "name"] and out.count() == want.count()
