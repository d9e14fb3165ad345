"""Added kinds of personal data on planted values: precision and recall per kind."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkcast.llm import pii

# Published examples of international account numbers.
IBANS = ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NL91ABNA0417164300"]


def made_iban(rng):
    """A number with right check digits."""
    body = "".join(rng.choice(list("0123456789"), 18))
    value = int(body + str(ord("D") - 55) + str(ord("E") - 55) + "00") % 97
    plain = f"DE{98 - value:02d}{body}"
    return " ".join(plain[k: k + 4] for k in range(0, len(plain), 4)) if rng.random() < 0.5 else plain


def test_check_digits(spark):
    wrong = [v[:-1] + ("0" if v[-1] != "0" else "1") for v in IBANS]
    df = spark.createDataFrame([(v,) for v in IBANS + wrong], "v string")
    assert [r[0] for r in df.select(pii.iban(F.col("v"))).collect()] == [True] * 4 + [False] * 4


def test_planted_values(spark):
    rng = np.random.default_rng(6)
    words = ["the", "value", "IN", "of", "NATO", "a", "report", "ABCD", "1999", "went", "12", "AB12"]
    kinds = {"account": made_iban, "secret": lambda r: hashlib.sha256(r.bytes(8)).hexdigest(), "none": lambda r: ""}
    lead = {"account": "IBAN: ", "secret": "token = ", "none": ""}
    table, want = [], {}
    for k in range(600):
        kind = list(kinds)[k % 3]
        before = " ".join(rng.choice(words, rng.integers(3, 40)))
        value = kinds[kind](rng)
        text = f"{before} . {lead[kind] if rng.random() < 0.8 else ''}"
        want[k] = (kind, len(text), len(text) + len(value))
        table.append((k, f"{text}{value} . {' '.join(rng.choice(words, 5))}"))
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for kind in ("account", "secret"):
        planted = {k for k, w in want.items() if w[0] == kind}
        hits = {k for k in planted if want[k] in got[k]}
        found = Counter(s[0] for spans in got.values() for s in spans)
        assert len(hits) >= 0.95 * len(planted), kind
        assert len(hits) >= 0.95 * found[kind], kind
    assert not any(got[k] for k, w in want.items() if w[0] == "none")


def test_a_secret_may_begin_with_many_letters(spark):
    text = lambda n: "key = " + "ab" * (n // 2) + "0123456789 end"
    rows = [(n, text(n)) for n in (20, 220, 5000)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.inline("spans"))
    kind = pii.KINDS.index("secret")
    assert {(r.doc_id, r.end - r.start) for r in found.collect() if r.kind == kind} == {(n, n + 10) for n, _ in rows}
