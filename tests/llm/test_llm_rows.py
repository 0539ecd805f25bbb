"""Sharding, packing, token counts, archives, vectors and toxicity beside plain loops, with awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing, shards, tokens, toxicity, vectors, warc
from ledgerloom.session import work_dir

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n", "word", " lead", "trail ", "two  blanks", "tab\there", "a\n\nb", "a \n b", "don't we'll I'M it's", "x y z",
    "café café 你好 \U0001f600", "a\x1cb \x1f c", "end<|endoftext|>of text", "<|startoftext|> hi", "<| not special |>",
    "İstanbul ΣΣ", "12345 6,7;8!!! ...", "​zero", "long" * 3000, "many words here. " * 4000, "line\r\nbreak\r\n",
]


def test_token_counts(spark):
    rnd = random.Random(2)
    pieces = [" ", "\n", "  ", "\t", "'s", "Don't", "word", "Wort", "9", "é", "--", "　", "\r\n", ".", "́", "<|endoftext|>", "\x85"]
    texts = TEXTS + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens int, n_bytes string")
    library = tokens.tokenizer(BYTES)
    for table in (0, 50):
        got = tokens.token_counts(docs, BYTES, 100, table=table).collect()
        assert len(got) == 2 * len(texts)
        for r in got:
            n = len(library.encode(r.text, add_special_tokens=False).ids) if r.text else 0
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100), r
    assert tokens.token_counts(docs.limit(0), BYTES).count() == 0


def test_packing(spark):
    rnd = random.Random(4)
    pieces = [" ", "\n", "word", "Wort", "9", "é", "--", "　", ".", "́", "\x85", " "]
    texts = TEXTS + [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 90))) for _ in range(200)]
    docs = spark.createDataFrame([(i if i else None, t, 5, "y") for i, t in enumerate(texts)], "doc_id long, text string, piece int, length string")
    docs = docs.unionByName(docs.limit(20))
    got = packing.pack_documents(docs, WORDS, 64).collect()
    library = tokens.tokenizer(WORDS)
    want = Counter()
    for d, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 1]
        for i in range(0, len(ids), 64):
            part = np.array(ids[i : i + 64], "<u4").tobytes()
            want[d, i // 64, i, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 64) + 1
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def exact_bins(sizes, capacity):
    """Fewest bins by trying all, for small instances."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_a_best_packing():
    rnd = random.Random(6)
    fired = 0
    for _ in range(250):
        capacity = rnd.choice([10, 17, 30])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = dict(Counter(sizes))
        bins = packing.reduction(counts, capacity)
        rest = sorted(Counter(counts).elements(), reverse=True)
        fixed = sum(n for _, n in bins)
        assert all(sum(b) <= capacity for b, _ in bins)
        assert sorted(rest + [x for b, n in bins for x in b * n]) == sorted(sizes)
        assert fixed + exact_bins(rest, capacity) == exact_bins(sizes, capacity), (capacity, sizes, bins)
        fired += fixed > 0
    assert fired > 200


def test_best_fit_places_every_piece_once():
    rnd = random.Random(7)
    counts = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, 101), 60)}
    left = dict(counts)
    plan = packing.best_fit(left, 100, packing.reduction(left, 100))
    ranks, rooms = {}, {}
    for p in plan:
        for k in range(p.count):
            ranks.setdefault(p.length, []).append(p.rank + k)
            rooms.setdefault(p.bin + k // p.each, []).append((p.offset + k % p.each * p.length, p.length))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    plain = []  # one piece after the other, each into the fullest bin that has room
    for size in sorted(Counter(counts).elements(), reverse=True):
        fit = [(room, i) for i, room in enumerate(plain) if room >= size]
        if fit:
            plain[min(fit)[1]] -= size
        else:
            plain.append(100 - size)
    assert len(rooms) <= len(plain)


def test_sequences(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 30)) for i in range(80)], "doc_id long, text string")
    rows = packing.pieces(docs, lambda: packing.WordIds(WORDS), 64, 1, ids=True)
    packed = packing.pack(rows, 64).cache()
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_shards(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None, ""]), rnd.choice([None, "", "é text", "x" * 999]), 1, "s") for i in range(2000)]
    rows[7] = (7, "a", "twin", 1, "s")
    rows += [(None, None, None, 1, "s")] * 5 + [(7, "a", "twin", 1, "s")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int, size string")
    got = shards.shard(docs, 40).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len(text(r[2])) + 16, zlib.crc32(text(r[2]))) for r in rows)
    by = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {r[0]: r[1] for r in rows if r[0] is not None}
    share = Counter((r.shard, source.get(r.doc_id)) for r in got if r.doc_id in source)
    for s in ("a", "b", "c"):
        n = sum(1 for r in rows if r[1] == s) / 40
        assert all(abs(share[k, s] - n) <= 2 for k in range(40))
    assert got != [] and shards.shard(docs, 40).exceptAll(spark.createDataFrame(got, shards.shard(docs, 40).schema)).count() == 0
    assert shards.shard(docs.limit(0), 40).count() == 0


def test_archives(spark):
    long = "<p>" + "é" * 60 + "</p>"
    big = "".join(chr(97 + i % 26) for i in range(3_000_000))
    rows = [
        (5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "u\r\nX: y", "short"), (2, "", "short"), (4, "http://b", None),
        (6, "http://b", ""), (None, "http://n", long), (3, "http://a/2", long), (7, "http://c", big), (8, "http://c", "WARC/1.1\r\n\r\n" * 30),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    index = warc.write_archives(pages, work_dir(spark, "warc-test"))
    got = warc.read_archives(index, payload=True).collect()
    assert len(got) == len(rows)
    import hashlib

    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = Counter()
    for page, url, html in rows:
        raw = (html or "").encode()
        to = first.get(html) if first.get(html) != page else None
        url = url if url is None else url.replace("\r", " ").replace("\n", " ") or "urn:none"
        want[page, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to, None if to is not None else raw] += 1
    assert want == Counter(
        (r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got
    )
    some = warc.fetch(index, spark.createDataFrame([(7,), (1,), (99,)], "page_id long")).collect()
    assert {r.page_id: len(r.payload) for r in some} == {7: len(big), 1: 5}
    none = warc.archive_round_trip(pages.limit(0))
    assert none.count() == 0


def plain_links(rows, threshold):
    usable = [
        (i, v, label, np.asarray(e, float)) for i, (v, label, e) in enumerate(rows)
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    ]
    count, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _, la, x) in enumerate(usable):
        for j, _, lb, y in usable[:a]:
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                count[i] += 1
                count[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (v, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(v)
    least = {g: min((v for v in vs if v is not None), default=None) for g, vs in groups.items()}
    return Counter((v, count[i], least[find(i)], v is not None and v == least[find(i)]) for i, (v, *_) in enumerate(rows))


@pytest.mark.parametrize("budget", [1 << 17, 64 * 12])
def test_vectors(spark, budget):
    rnd = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            center = rnd.normal(size=12)
            for _ in range(int(rnd.integers(1, 12))):
                rows.append((n, label, (center + rnd.normal(size=12) * rnd.choice([0, 0.05, 0.25, 0.35])).tolist()))
                n += 1
    rows += [(n + k, 0, (rnd.normal(size=12) * 1e200).tolist()) for k in range(3)]
    rows += [(9000, None, rows[0][2]), (9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 12), (9004, 0, [math.nan] * 12), (9005, 1, [None] * 12)]
    rows += [(9006, 0, [math.inf] + [0.0] * 11), (None, 0, rows[0][2]), (0, 0, rows[0][2]), (9007, 0, [1.0, 0.0]), (9008, 0, [1.0, 0.01])]
    rows += [(9100 + k, 1, [2.0 * x for x in rows[40][2]]) for k in range(150)]
    table = spark.createDataFrame([(*r, 3, "z") for r in rows], "vec_id long, label int, embedding array<double>, n_links int, kept string")
    got = vectors.near_vectors(table, 0.93, budget).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == plain_links(rows, 0.93)
    assert vectors.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [16, 64, 384, 768])
def test_cover_trees_of_nearly_equal_vectors_end(size):
    """Scaled copies and vectors that differ by a last place: every child is smaller than its parent."""
    for seed in range(12):
        rnd = np.random.default_rng(seed)
        one = rnd.normal(size=size)
        copies = np.outer(rnd.uniform(0.1, 10, 30), one)
        close = np.repeat(one.astype(np.float32)[None], 30, axis=0)
        close[np.arange(30), np.arange(30) % size] = np.nextafter(close[np.arange(30), np.arange(30) % size], np.float32(9))
        for rows in (copies, close.astype(float), np.vstack([copies, close])):
            points = vectors.unit(rows)
            tree = vectors.CoverTree(points)
            assert len(tree.center) < 4 * len(rows)
            count, _, roots = vectors.links(tree, tree, np.ones(len(rows), int), np.ones(len(rows), int), 0.93, True)
            assert (count == len(rows) - 1).all() and len(set(roots)) == 1


@pytest.mark.parametrize("size", [16, 64, 384])
def test_links_at_the_threshold(size):
    """Two clusters whose centres are at the threshold give or take 1e-9: links as by comparing all pairs."""
    for seed in range(6):
        rnd = np.random.default_rng(seed)
        base = vectors.unit(rnd.normal(size=(2, size)))
        side = base[1] - (base[0] @ base[1]) * base[0]
        side /= np.linalg.norm(side)
        for cosine in (0.93 - 3e-9, 0.93 - 1e-9, 0.93 + 1e-9, 0.93 + 3e-9):
            other = cosine * base[0] + math.sqrt(1 - cosine**2) * side
            rows = np.vstack([base[0] + rnd.normal(size=(24, size)) * 1e-9, other + rnd.normal(size=(24, size)) * 1e-9])
            points = vectors.unit(rows)
            tree = vectors.CoverTree(points)
            ones = np.ones(len(rows), int)
            count, _, _ = vectors.links(tree, tree, ones, ones, 0.93, True)
            dot = points @ points.T
            sure = (abs(dot - 0.93) > 1e-13).all(axis=1)
            assert (count == (dot >= 0.93).sum(axis=1) - 1)[sure].all() and sure.any()


def test_cover_tree_prunes():
    rnd = np.random.default_rng(1)
    centers = vectors.unit(rnd.normal(size=(30, 24)))
    points = vectors.unit(np.repeat(centers, 40, axis=0) + rnd.normal(size=(1200, 24)) * 0.02)
    tree = vectors.CoverTree(points)
    compared = sum(m.size for _, _, m in vectors.traverse(tree, tree, 0.93, True) if m is not None)
    assert compared < 0.05 * len(points) ** 2 / 2
    for node, kids in enumerate(tree.children):
        if kids is not None:
            assert sorted(np.concatenate([tree.points[k] for k in kids])) == sorted(tree.points[node])
            assert all(tree.radius[k] <= 1 for k in kids)


def test_toxicity(spark, folder):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rnd.randint(1, 60))]
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["zidiot", "zmoron"]) + word()[:2]
        if junk:
            words += ["spamspam"] * 3
        rows.append((i, " ".join(words), "x"))
        if i < 400:
            labels.append((i, int(not junk), int(bad)))
    rows += [(None, "zidiot", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "... !!", "x"), (1003, "hello " * 50_000 + "zidiotab", "x")]
    labels += [(None, 1, 1), (3, None, 1), (4, 1, None), (99999, 1, 1), (5, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scores string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = toxicity.labelled(table)
    got = {r.doc_id: r.p for r in toxicity.score(docs, known, ["low_quality", "toxic"], name="p").collect()}
    assert len(got) == len(rows)
    for i in range(400, 600):
        assert (got[i][1] >= 0.5) == (i % 5 == 0) and (got[i][0] >= 0.5) == (i % 7 == 0)
    assert got[1000] == got[1001] == got[1002] == [0.0, 0.0] and got[1003][1] >= 0.5
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1000, 1001, 1002}
    assert toxicity.drop_toxic(docs, table.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(docs.limit(0), table).count() == 0
    one_class = table.withColumn("toxic", F.lit(0))
    assert toxicity.drop_toxic(docs, one_class).count() == len(rows)


def test_training_rows_are_bounded(spark):
    """Most rows share one labelled id, most labels have no document: neither fills the sample, one row an id."""
    docs = spark.createDataFrame([(7, f"w{i % 3} same", "x") for i in range(3000)] + [(i, f"w{i}", "x") for i in range(100, 160)], "doc_id long, text string, mark string")
    known = [(7, 1, 0)] + [(i, 1, i % 2) for i in range(100, 160)] + [(i, 1, 1) for i in range(10_000, 30_000)]
    labels = toxicity.labelled(spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    for bound, want in ((1000, 61), (20, 20)):
        features, values = toxicity.training_rows(docs, labels, ["low_quality", "toxic"], bound)
        assert len(features) == len(values) == want


def test_words_are_counted_over_all_texts(spark):
    rows = [(i, " ".join([f"w{i % 40}"] * (i % 40 + 1)) + " once" + str(i)) for i in range(800)] + [(None, None), (1, ""), (2, "x" * 100 + " " + "x" * 100)]
    rows += [(3, "late " * 30_000)]  # one word at the end of the table counts as all others do
    want = Counter(w for _, t in rows for w in (t or "").split())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = sorted((w for w, n in want.items() if n > 1 and len(w) <= tokens.LONGEST), key=lambda w: (-want[w], w))
    assert tokens.frequent_words(docs, 1000) == known
    few = tokens.frequent_words(docs, 10)
    assert 5 <= len(few) <= 10 and few == known[: len(few)] and few[0] == "late"
    assert set(tokens.frequent_words(docs, 1000, held=3)) <= set(known)
    assert tokens.frequent_words(docs.limit(0), 10) == []


def test_word_ids_forget_and_find_again(monkeypatch):
    """A cache of a few words and groups of a few characters give what the library gives, also for odd letters."""
    monkeypatch.setattr(packing, "CACHE", 5)
    library = tokens.tokenizer(WORDS)
    rnd = random.Random(3)
    texts = [*TEXTS[:-3], *(" ".join(rnd.choice(["Wort", "don't", "é", "x" * 70, "9a", "--", "end", "of", "w" + str(rnd.randint(0, 30))]) for _ in range(20)) for _ in range(200))]
    texts += ["Ärger, ÄRGER. naïve?! Straße) ſ İi Ǆ ﬁx क़ e\u0301 x' 's, don't. a,b .,; ß;;; ÿÿ|&", "ABC abc Abc. abc, ABC***"]
    ids = packing.WordIds(WORDS)
    ids.TOGETHER = 200
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"" for t in texts]
    assert ids.many(texts) == want


def test_toxicity_on_held_out_rows(spark, folder):
    """Fitted on half of the labelled documents, judged on the other half."""
    big = folder.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    held = docs.join(labels.where(~half).select("doc_id", "toxic"), "doc_id")
    known = toxicity.labelled(labels.where(half))
    got = toxicity.score(held, known, ["low_quality", "toxic"], name="p", corpus=docs)
    got = got.select("toxic", (F.col("p")[1] >= 0.3).alias("hit"))
    n = {(r.toxic, r.hit): r["count"] for r in got.groupBy("toxic", "hit").count().collect()}
    caught, false = n.get((1, True), 0), n.get((0, True), 0)
    assert caught >= 0.9 * (caught + n.get((1, False), 0)) and false <= 0.02 * n[0, False], n
