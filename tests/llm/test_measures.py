"""Measured recall and precision: discovery of identifiers that no base pattern
knows, and near duplicates of a whole table against all pairs."""

import numpy as np

from tankcast.llm import minhash, pii
from tankcast.llm.common import table


def test_discovery_finds_planted_identifiers(spark):
    rng = np.random.default_rng(17)
    plain = ["river", "stone", "market", "window", "garden", "letter", "winter", "number", "street", "paper"]
    told = ["contact handle", "write to", "member id"]  # contexts that seeds share with unseen identifiers
    other = ["version tag", "room key", "in year", "about page", "step no"]  # with tokens that are no identifiers

    def prose(n):
        return " ".join(rng.choice(plain, n))

    def code():
        return f"{rng.choice(['ax', 'bo', 'cy'])}_{rng.integers(10**4, 10**6)}#{rng.integers(10)}"

    texts, planted = [], {}
    for i in range(900):
        where = told[i % 3]
        if i % 3 == i % 9 // 3:  # a third of each context's documents hold a seed
            texts.append(f"{prose(12)} {where} u{rng.integers(10**6)}@mail{i % 5}.org {prose(9)}")
        elif i % 2:
            hidden = code()
            planted[i] = hidden
            texts.append(f"{prose(7)} {where} {hidden} {prose(14)} {rng.choice(other)} {rng.integers(10, 99999)}x {prose(3)}")
        else:
            texts.append(f"{prose(10)} {rng.choice(other)} {code()} {prose(8)} {rng.choice(other)} {rng.integers(1900, 2030)} {prose(4)}")
    right = wrong = 0
    got = pii.op9_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if kind == "context":
                hit = texts[r.doc_id][int(a):int(b)] == planted.get(r.doc_id)
                right, wrong = right + hit, wrong + (not hit)
    print(f"recall {right / len(planted):.3f}, precision {right / max(right + wrong, 1):.3f}, {len(planted)} planted")
    assert right >= 0.95 * len(planted) and right >= 0.95 * (right + wrong)


def test_near_duplicates_on_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = dict(minhash.op3_near_duplicates(docs).collect())
    want = minhash.brute_force(dict(docs.collect()))
    print(f"{sum(k != v for k, v in want.items())} of {len(want)} documents are copies of another")
    assert got == want
