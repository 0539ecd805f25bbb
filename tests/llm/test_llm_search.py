"""Style trees, periodic runs and ranked search beside plain loops, with awkward rows."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import runs, search, styletree

DOCS = "doc_id long, text string, found string, rank int, score long"


def table(spark, rows, schema):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def plain_runs(words, exponent=4, least=6):
    n, out = len(words), set()
    for start in range(n):
        for q in range(1, (n - start) // exponent + 1):
            if start and start - 1 + q < n and words[start - 1] == words[start - 1 + q]:
                continue
            same = 0
            while start + same + q < n and words[start + same] == words[start + same + q]:
                same += 1
            length = same + q
            shorter = any(all(words[start + i] == words[start + i + p] for i in range(length - p)) for p in range(1, q))
            if length >= max(least, exponent * q) and not shorter:
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_beside_all_stretches(exponent, least):
    rnd, seen = random.Random(exponent), 0
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            words = [bytes([97 + rnd.randrange(rnd.choice([1, 2, 2, 3]))]) for _ in range(rnd.randint(0, 50))]
            block = [bytes([97 + rnd.randrange(3)]) for _ in range(rnd.randint(1, 8))]
            texts.append(words + block * rnd.randint(0, 7) + words[: rnd.randint(0, 9)])
        got = runs.runs(texts, exponent, least)
        assert got == [plain_runs(t, exponent, least) for t in texts]
        seen += sum(map(len, got))
    assert seen > 500


def test_runs_of_long_texts_take_linear_space_and_time():
    for words, want in (
        ([b"a"] * 200_000, [(0, 200_000, 1)]), ([b"x"] + [b"a", b"b"] * 60_000, [(1, 120_000, 2)]),
        ([b"a", b"b", b"c"] * 3, []),
    ):
        assert runs.runs([words]) == [want]


def test_periodic_runs(spark):
    rnd = random.Random(9)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (4, "Wort é " * 9), (4, "Wort é " * 9), (2**62 + 1, "x\x0by\x1cz")]
    for i in range(10, 160):
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(rnd.choice(["a", "b", "cé", " "]) for _ in range(rnd.randint(1, 90)))))
    rows.append((500, " ".join(f"w{i % 7000}" for i in range(30_000))))
    frame = table(spark, rows, DOCS)
    planted = 0
    for plant in (False, True):
        got = runs.periodic_runs(frame, plant=plant)
        assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
        key = lambda r: (str(r[0]), str(r[1]))
        result = sorted(got.collect(), key=key)
        assert [(r.doc_id, r.text) for r in result] == sorted(rows, key=key)
        for r in result:
            raw = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
            words = list(raw)
            h = runs.zlib.crc32(str(r.doc_id).encode())
            if plant and r.doc_id is not None and h % 10 == 0 and words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
                planted += 1
            if len(words) > 1000:
                assert r.found.n_runs == len(r.found.runs)
                continue
            want = plain_runs(words)
            drop = {i for s, n, q in want for i in range(s + q, s + n)}
            left = b" ".join(w for i, w in enumerate(words) if i not in drop)
            best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
            f = r.found
            assert (f.n_runs, f.start, f.length, f.period) == (len(want), *best)
            assert f.exponent_milli == (1000 * best[1] // best[2] if want else None)
            assert f.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
            assert f.collapsed_sha256 == hashlib.sha256(left).hexdigest() and f.collapsed.encode() == left
            assert [tuple(x) for x in f.runs] == want
    assert planted > 5
    assert runs.periodic_runs(frame.limit(0), plant=True).collect() == []


def plain_search(docs, queries, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    texts = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    total, length = sum(n > 0 for *_, n in texts), sum(n for *_, n in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = []
    for item, text in queries:
        found = []
        for doc, counts, n in texts:
            m = 25 + 75 * n * total // max(1, length)
            score = 0
            for w in cut(text):
                tf = counts[w]
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


ITEMS = "item_id long, text string, doc_id long"


@pytest.mark.parametrize("vocabulary,leaf,block", [(8192, 64, 16_384), (12, 2, 40), (40, 4, 7)])
def test_search(spark, monkeypatch, vocabulary, leaf, block):
    rnd = random.Random(7)
    word = lambda: f"w{min(int(rnd.expovariate(0.04)), 150)}"
    docs = [(None, "w1 w2 W3"), (None, None), (1, ""), (2, " ?! "), (3, "É é w1"), (4, "w1 " * 5000)]
    docs += [(i, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(10, 250)]
    docs += [(i, docs[20][1]) for i in range(300, 460)] + [(11, docs[7][1])]
    items = [(1, "w1 w1 w9, w70"), (2, None), (3, ""), (4, "unknown words"), (5, docs[20][1]), (None, "É W3"), (7, "w1"), (7, "w1")]
    items += [(i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(20, 40)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(plain_search(docs, items), key=key)
    frame = table(spark, docs, DOCS).repartition(3)
    monkeypatch.setattr(search, "LEAF", leaf)
    monkeypatch.setattr(search, "BLOCK", block)
    got = search.search(frame, table(spark, items, ITEMS), vocabulary=vocabulary)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    if leaf == 64:
        assert search.search(frame.limit(0), table(spark, items, ITEMS)).collect() == []
        assert search.search(frame, table(spark, items[:0], ITEMS)).collect() == []


def test_search_passes_over_subtrees():
    """Of documents on many subjects, those of others than the query's are hardly scored."""
    import numpy as np

    rnd = random.Random(2)
    vectors = []
    for _ in range(5000):
        subject = 20 * rnd.randrange(20)
        terms = np.array(sorted(rnd.sample(range(subject, subject + 20), 12)), np.int64)
        vectors.append((terms, np.ones(12, np.int64)))
    ids, m, rank = np.arange(5000), np.full(5000, 100), np.arange(400)
    trie = search.grow(ids, np.ones(5000, bool), m, vectors, rank)
    top, terms = [], vectors[1234][0]
    scored = search.best(trie, terms, np.full(12, 3000, np.int64), np.zeros(400, np.int64), top, 10)
    assert max(top)[2] == -1234 and scored < 1000


PAGES = "page_id long, url string, html string, text string, site string, n_chars int, gone int"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_named_parts():
    """What names say: each page's main text is stated beside it."""
    cases = [
        ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<b>a</b>b &amp; c&nbsp;&nbsp;d &lt;i&gt;", "ab & c d <i>"),
        ("<nav>x</nav><p>a</p><footer>y", "a"), ("<script>var t='</p>';</script>a<style>p{}</style>", "a"), ("a<br>b<br/>c", "a b c"),
        ("<div class='ad'>x</div><article><h1>T</h1><p>a</article><footer>f</footer>", "T a"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1><i>by me</i></header>a</article>", "T a"),
        ("<main><p>a</p><aside>x</aside><form>q<input></form><section class='comments'><article>c</article></section></main>", "a"),
        ("<div id=content>a<div class='cookie-notice'>x</div></div><div>y</div>", "a"),
        ("<body class='has-sidebar'><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<!-- <p>no --><p>a <!-- <nav> --> b", "a b"), ("a < b <3 c", "a < b <3 c"), ("<p title='x>y'>a</p>", "a"), ("<p>a</div></b>b", "a b"),
        ("<aside>x<p>y", ""), ("<div><nav>x</div><p>a</p>", "a"), ("<p hidden>x</p><p>a", "a"), ("<head><title>t</title><p>a", "a"),
        ("<span class='share'>x</span>a <a href=/x>b</a>", "a b"), ("<article>a</article><article>b</article>", "a b"),
        ("<textarea>x</textarea><select><option>y</select>a", "a"), ("<div role=banner>x</div><div role=main>a</div>b", "a"), ("<script>a", ""),
    ]
    for markup, want in cases:
        assert styletree.main_text(styletree.parse(markup), set()) == want, markup
    deep = "<div>" * 30_000 + "a" + "</b>" * 100
    assert styletree.main_text(styletree.parse(deep), set()) == "a"


def test_extract_main(spark):
    rnd = random.Random(4)
    rows, want = [(None, None, None), (1, "http://a.example/x", ""), (2, "no url", "<p>a")], {(None, None): "", (1, None): "", (2, None): "a"}
    for i in range(40):  # a site whose furniture no name marks
        title, one, two = words(rnd, 4), words(rnd, 30), words(rnd, 12)
        more = f"<p>{words(rnd, 9)}</p>" if i % 3 else ""
        page = (
            f"<html><body><div class=x1><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></div><div class=x2><h2>{title}</h2>"
            f"<p>{one}<p>{two} &lt;b&gt; {more}</div><div class=x3>Join our <b>club</b> now</div><div>Made 2020</div></body></html>"
        )
        rows.append((10 + i, f"HTTPS://user@Plain.example:80/{i}?x=http://b.example", page))
        text = f"{title} {one} {two} <b> {more[3:-4]}".strip()
        want[(10 + i, None)] = " ".join(text.split())
    for i in range(30):  # copies of one article, and a single page
        body = "<div class=y1>Hello</div><p>" + " ".join(f"w{j}" for j in range(300)) if i < 29 else f"<p>{words(rnd, 20)}"
        rows.append((100 + i, f"https://copies.example/{i}", body))
        want[(100 + i, None)] = styletree.main_text(styletree.parse(body), set())
    rows += [rows[-1], (10, "https://other.example", "<div>Made 2020</div>")]
    want[(10, "o")] = "Made 2020"
    result = styletree.extract_main(table(spark, rows, PAGES)).collect()
    assert len(result) == len(rows)
    for r in result:
        assert r.text == want[(r.page_id, "o" if r.url and "other" in r.url else None)], r
        assert r.n_chars == len(r.text)
    got = styletree.extract_main(table(spark, rows, PAGES).limit(0))
    assert got.collect() == [] and sorted(got.columns) == sorted(["page_id", "url", "text", "site", "n_chars", "gone"])


def test_articles_of_the_given_pages(spark, folder):
    """In the given pages the article is all between its tags, and only that."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    result = {r.page_id: r.text for r in styletree.extract_main(pages).collect()}
    assert len(result) == pages.count()
    for page in pages.collect():
        inner = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        assert result[page.page_id] == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())
