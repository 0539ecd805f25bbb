"""Line dedup, passages, SimHash and decontamination beside plain loops, with awkward rows."""

import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash

from ledgerloom.llm import decontaminate, lines, passages, simhash
from ledgerloom.llm.common import components, letter_words, merged

DOCS = "doc_id long, text string, lang string, n_words int, component_id string, leak int"


def table(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages and lines, nulls, empty ones, repeats and one long text."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (30, 49, 50, 51, 70, 120)]
    block = "\n".join(" ".join(word() for _ in range(4)) for _ in range(4))
    rows = [(None, "null id\nof two"), (1, None), (2, ""), (3, "   \n\n"), (4, "One"), (4, "One"), (5, "ONE two"), (6, "\n".join("x" * 1 for _ in range(9)))]
    for i in range(10, 60):
        text = [" ".join(word() for _ in range(rnd.randint(1, 80)))]
        for _ in range(rnd.randint(0, 3)):
            text.append(rnd.choice(shared) if rnd.random() < 0.6 else block)
            text.append(" ".join(word() for _ in range(rnd.randint(0, 40))))
        sep = rnd.choice([" ", "\n", ". "])
        rows.append((i, sep.join(text)))
    rows += [(100, rows[20][1]), (101, rows[20][1]), (101, rows[20][1]), (102, rows[30][1].upper())]
    rows.append((103, "\n".join(f"{word()} {word()}" for _ in range(20_000))))
    return rows


def order(rows):
    return sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))


def test_line_dedup(spark, corpus):
    kept, gone = {}, {}
    for doc, text in order(corpus):
        split = [(i, x) for i, x in enumerate((text or "").split("\n")) if x]
        for n in range(len(split) - 2):
            window = tuple(x for _, x in split[n : n + 3])
            first = kept.setdefault(window, (doc, text, n))
            if first[:2] != (doc, text) or n >= first[2] + 3:
                gone.setdefault((doc, text), set()).update(i for i, _ in split[n : n + 3])

    def want(doc, text):
        if text is None:
            return None
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((doc, text), ()))

    got = lines.dedupe_lines(table(spark, corpus))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(((d, want(d, t)) for d, t in corpus), key=key)
    report = {(r.doc_id, r.text): r for r in lines.line_report(table(spark, corpus)).collect()}
    for doc, text in corpus:
        r = report[(doc, want(doc, text))]
        assert (r.n_lines, r.n_removed) == (0 if text is None else text.count("\n") + 1, len(gone.get((doc, text), ())))
    assert gone


def test_passages(spark, corpus):
    first, later = {}, {}
    for doc, text in order(corpus):
        words = letter_words(text)
        for i in range(len(words) - 49):
            gram = tuple(words[i : i + 50])
            if first.setdefault(gram, (doc, text, i)) != (doc, text, i):
                later.setdefault((doc, text), set()).update(range(i, i + 50))
    rows = passages.repeated_passages(table(spark, corpus)).collect()
    texts, got = {}, {}
    for doc, text in corpus:
        texts.setdefault(doc, []).append(letter_words(text))
    by_id = {d for d, _ in later}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        mine = [w[r.start : r.start + r.length] for w in texts[r.doc_id]]
        source = [w[r.source_start : r.source_start + r.length] for w in texts[r.source_doc_id]]
        assert r.length >= 50 and any(m in source and len(m) == r.length for m in mine)
    assert by_id == set(got)
    missing = {d: v - got[d] for (d, _), v in later.items() if v - got[d]}
    assert not missing
    cut = passages.remove_passages(table(spark, corpus)).collect()
    assert len(cut) == len(corpus)
    assert sum(len(letter_words(r.text)) for r in cut) < sum(len(letter_words(t)) for _, t in corpus)


def test_passages_between_others(spark):
    """Texts that share parts of a passage of every length stand between those that share it whole."""
    rnd = random.Random(9)
    words = lambda n: " ".join(str(rnd.randrange(10**9)) for _ in range(n))
    rows = []
    for case in range(12):
        passage = words(rnd.choice((50, 51, 58, 70, 90))).split()
        for i in range(12):
            low, high = (0, len(passage)) if rnd.random() < 0.4 else (rnd.randrange(16), len(passage) - rnd.randrange(16))
            rows.append((case * 100 + i, " ".join([words(rnd.randrange(40)), *passage[low:high], words(rnd.randrange(40))])))
    first, later = {}, {}
    for doc, text in rows:
        split = letter_words(text)
        for i in range(len(split) - 49):
            if first.setdefault(tuple(split[i : i + 50]), (doc, i)) != (doc, i):
                later.setdefault(doc, set()).update(range(i, i + 50))
    got = {}
    for r in passages.repeated_passages(table(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        assert r.length >= 50 and r.source_doc_id < r.doc_id
    assert got == later


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, corpus):
    near = [(i, t) for i, t in corpus if len(t or "") < 5_000]
    rnd = random.Random(8)
    for k in range(60):  # near copies
        words = near[10 + k % 20][1].split(" ")
        words[rnd.randrange(len(words))] = "other"
        near.append((500 + k, " ".join(words)))
    prints = {(d, t): plain_fingerprint(t) for d, t in near}
    values = sorted(set(prints.values()))
    group = plain_components(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for (d, _), f in prints.items():
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    got = simhash.near_duplicates(table(spark, near)).collect()
    assert len(got) == len(near)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == sorted(
        (str(d), prints[d, t], str(least.get(group[prints[d, t]]))) for d, t in near
    )
    kept = simhash.drop_near_duplicates(table(spark, near))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        {str(least.get(group[f])) for f in prints.values()}
    )


def test_fingerprints_at_each_distance(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(150)]
    near = set(base)
    for b in base:
        for flips in (1, 2, 3, 4):
            near.add(b ^ sum(1 << x for x in rnd.sample(range(64), flips)))
        near.add(b ^ 0b111)  # all three in one block
    values = [v - (1 << 64) if v >> 63 else v for v in near]
    want = plain_components(values, [(a, b) for a, b in combinations(values, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    got = simhash.near_components(spark.createDataFrame([(v,) for v in values] * 2, "fp long")).collect()
    assert {r.fp: r.group for r in got} == want and len(got) == len(want)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i + 1000, i + 1001) for i in range(80)] + [(0, 5)] * 3
    want = plain_components({x for p in pairs for x in p}, pairs)
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    rows = spark.createDataFrame([*pairs, (None, 1), (7000, 7000)], "a long, b long")
    assert {r.node: r.component for r in components(rows).collect()} == {n: c for n, c in want.items() if n not in alone}
    assert components(rows.limit(0)).count() == 0


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"), (2, "Short item"), (3, None), (4, ""),
    (None, "nobody knows this one"), (2, "Short item"), (5, "ÄPFEL äpfel 9 birnen"), (6, "short ITEM"),
]
CASES = [
    (1, "x alpha, beta-gamma delta epsilon zeta eta theta iota KAPPA lamda MU y"), (2, "alpha beta gamma short... item"),
    (3, None), (4, ""), (None, "nobody knows this one"), (5, "clean text"), (5, "clean text"), (6, "Äpfel äpfel 9 birnen"),
    (7, "ÄPFEL ÄPFEL 9 birnen"), (8, "short item " * 4000),
]


def plain_leak(text, n=10):
    words = letter_words(text)
    hit, items = set(), set()
    for item, body in ITEMS:
        w = letter_words(body)
        size = min(n, len(w))
        for g in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == g:
                    hit.update(range(i, i + size))
                    items |= {item} - {None}
    return len(words), hit, items


@pytest.mark.parametrize("block", [200_000, 2])
def test_contamination(spark, block):
    docs = table(spark, CASES)
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    out = decontaminate.contamination(docs, bench, block=block, leak="found").collect()
    assert len(out) == len(CASES)
    for r in out:
        n, hit, items = plain_leak(r.text)
        assert (r.found.n_words, {k for s in r.found.spans for k in range(s.s, s.e)}, set(r.found.items)) == (n, hit, items)
    kept = decontaminate.decontaminate(docs, bench, block=block)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in CASES if not plain_leak(t)[1])
    cut = {str(r.doc_id): r.text for r in decontaminate.decontaminate(docs, bench, "spans", block=block).collect()}
    assert cut["1"] == "x  y" and cut["5"] == "clean text" and cut["2"] == "alpha beta gamma " and cut["3"] is None


def test_empty_tables(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lines.dedupe_lines(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(table(spark, CASES), bench).count() == len(CASES)


def test_merged():
    assert merged([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
