"""The license scan against all rules tried on every text, without gates and with containment by pairs."""

from __future__ import annotations

import random
import re
import re._parser as parser
import time

from test_whole_job import phrases

from quirelight.llm import queries as Q
from quirelight.llm.licenses import BASE, MORE, TEXTS, rules, scan_licenses

SF = "/root/testdata/sf0.001"
ALL = [(k, label, p, re.compile(rf"(?<= ){x}(?= )")) for k, (label, p, _, x) in enumerate(rules())]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    norm = f" {' '.join(words)} "
    hits = [(k, label, p, m.start(), m.end()) for k, label, p, x in ALL for m in x.finditer(norm)]

    def inside(h):
        return any(b[0] != h[0] and b[3] <= h[3] and h[4] <= b[4] and (b[2] > h[2] or (b[2] == h[2] and (b[4] - b[3] > h[4] - h[3] or b[0] < h[0]))) for b in hits)

    found = [h for h in hits if not inside(h)]
    base = [label for phrase, label in BASE if f" {phrase} " in norm]
    places = [norm[: m.start()].count(" ") - 1 for phrase, _ in BASE for m in re.finditer(rf"(?<= ){phrase}(?= )", norm)]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *(h[1] for h in found)})), max((h[2] for h in found), default=0) / 100


def test_scan_equals_a_plain_version(spark, tmp_path):
    assert len(TEXTS) + len(MORE) > 150 and len(rules()) > 400
    rng = random.Random(4)
    some = [rng.choice(phrases(parser.parse(x))) for _, _, _, x in rules()]
    texts = [f"# {x.title()}," for x in some]
    for _ in range(150):
        parts = [rng.choice([*some, "filler words here", "é中", "licen ces", "\x00"]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice([" ", "\n", ", ", " -- "]).join(parts))
    rows = list(enumerate([*texts, None, "", "copyright (c) 1996 - 2024, Daniel Stenberg"]))
    rows += [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, *plain(t)) for i, t in rows}
    assert {tuple(r) for r in Q.op6_license_scan(spark, str(tmp_path)).collect()} == want


def test_many_hits_in_one_text(spark):
    text = "MIT License, apache license 2.0; GNU General Public License v3. " * 4000
    start = time.time()
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert time.time() - start < 60 and len(row["places"]) == 12_000 and row["labels"] == ["apache", "apache-2.0", "gpl", "gpl-3.0", "mit"]
