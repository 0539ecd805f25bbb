"""The fingerprints of operator 10 find near duplicates of the pipeline by themselves."""

import random

import corpus_pipeline
from ledgerloom.llm import similar, simhash


def test_fingerprints_find_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    rows, want, unlike = [], [], []
    for k in range(12):  # near copies, some of them within 3 bits
        words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
        other = words[:200] + ["changed"] + words[201:]
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        (want if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3 else unlike).append(2 * k + 1)
    rows += [(100, "one two"), (101, "ONE  two")]  # one set of shingles
    assert want
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def none(signed):
        t = signed.select("t").limit(0)
        return t.selectExpr("t as a", "t as b"), t

    monkeypatch.setattr(similar, "candidates", none)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - set(want) - {101}
