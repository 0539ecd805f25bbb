"""Stages of the pipeline beside plain loops."""

import hashlib
import random
from itertools import combinations

import pytest

import corpus_pipeline
from ledgerloom.llm import passages, similar

SCHEMA = "doc_id long, text string, lang string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Ids that stay: the smallest of each group that Jaccard similarities of 0.8 or more link."""
    sets = [(i, plain_shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if not (x or y) or len(x & y) >= 0.8 * len(x | y) and x and y:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in parent})


def test_near_duplicates_by_jaccard(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(3, 7)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two words")]
    for k in range(40):  # pairs from nearly equal to clearly different
        words = [word() for _ in range(rnd.randint(40, 200))]
        rows.append((100 + 2 * k, " ".join(words)))
        for _ in range(1 + len(words) * (k % 8) // 200):
            words[rnd.randrange(len(words))] = word()
        rows.append((101 + 2 * k, " ".join(words)))
    words = [word() for _ in range(120)]
    for k in range(60):  # a group larger than the keys compare in full
        one = list(words)
        one[rnd.randrange(120)] = word()
        rows.append((300 + k, " ".join(one)))
    short = "a few words that all of these short texts have in common"
    rows += [(400 + k, f"{short} {word()} {word()} {word()} {word()} {word()} {word()}") for k in range(30)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    want = plain_groups(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert 60 < len(want) < 100
    assert kept.count() == dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.union(docs), "").count()
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.limit(0), "").count() == 0


def test_long_lines(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(3, 6)))
    line = lambda n: (" " if n % 2 else "  ").join(word() for _ in range(n))
    shared = [line(n) for n in (1, 9, 20, 25, 30, 49, 50, 51, 80)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, shared[-1]), (5, shared[-1]), (6, "\n".join([shared[-2]] * 4)), (7, shared[0])]
    for k in range(80):
        rows.append((10 + k, rnd.choice(["\n", "\n\n"]).join(rnd.choice(shared) if rnd.random() < 0.6 else line(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 5)))))
    first, gone = {}, {}
    for doc, text in rows:
        split = [(i, x) for i, x in enumerate((text or "").split("\n")) if x]
        for size in (1, 2, 3):
            for n in range(len(split) - size + 1):
                run = tuple(x for _, x in split[n : n + size])
                if size == 3 or sum(len(x.split()) for x in run) >= 50:
                    at = first.setdefault(run, (doc, n))
                    if at[0] != doc or n >= at[1] + size:
                        gone.setdefault(doc, set()).update(i for i, _ in split[n : n + size])
    want = {d: t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == want
    assert got[5] == "" and got[7] == shared[0] and sum(map(len, gone.values())) > 20


def test_stretches_are_cut_once(spark, monkeypatch):
    """A stretch that many runs ask for is cut once and given to each of them, whatever its text's rows."""
    words = [f"w{i}" for i in range(9_000)]
    rows = [(None, 7, " ".join(words)), (3, 8, " ".join(words[::-1])), (3, 8, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text_key long, text string")
    at = [(None, 7, 10, 60), (None, 7, 8_000, 8_035), (3, 8, 0, 35)]
    wanted = [(3 * n + k, n % 3, *place) for n in range(900) for k, place in enumerate(at)]
    asked = spark.createDataFrame(wanted, "run long, side int, doc_id long, text_key long, start long, stop long")
    seen, stored = {}, passages.stored

    def watched(frame, name):
        seen[name] = stored(frame, name)
        return seen[name]

    monkeypatch.setattr(passages, "stored", watched)
    got = {(r.run, r.side): r for r in passages._contexts(docs, asked, 34, 15).collect()}
    assert len(got) == len(wanted)
    for run, side, doc, _, start, stop in wanted:
        text, far = (words if doc is None else words[::-1]), 15 if side == 2 else 34
        r = got[run, side]
        assert bytes(r.body) == hashlib.md5(" ".join(text[start:stop]).encode()).digest()
        assert (len(r.left), len(r.right)) == (min(far, start), far)
    assert seen["stretches"].count() == 6  # three stretches with two reaches
    assert max(len(r.asked) for r in seen["asked"].collect()) <= 2


@pytest.mark.parametrize("whole,rare", [(8, 32), (2, 3)])
def test_near_duplicates_in_large_keys(spark, monkeypatch, whole, rare):
    """Families of one template, unlike each other, whose members have one near copy each; copies with edits; chains."""
    monkeypatch.setattr(similar, "WHOLE", whole)
    monkeypatch.setattr(similar, "RARE", rare)
    rnd = random.Random(whole)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(2):
        template = [word() for _ in range(140)]
        for _ in range(40):
            own = [word() for _ in range(30)]
            texts += [template + own, template + own[:17] + [word() for _ in range(13)]]
    base = [word() for _ in range(150)]
    for i in range(60):  # edits of one text, nearly all alike
        text = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 4)):
            text[at] = word()
        texts.append(text)
    chain = [word() for _ in range(150)]
    for _ in range(25):  # each is like the one before, the ends are not
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(list(chain))
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(r.doc_id for r in similar.drop_similar(docs).collect())
    assert got == sorted(plain_groups(rows)) and len(got) > 80
