"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontaminate,
    lines,
    packing,
    passages,
    runs,
    search,
    shards,
    simhash,
    styletree,
    tokens,
    toxicity,
    vectors,
    warc,
)
from ledgerloom.sources.tables import table


def op1_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), 0.93)


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    leak = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    names = F.concat_ws(",", F.array_sort(F.transform("leak.items", lambda x: x.cast("string"))))
    return leak.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = toxicity.labelled(table(spark, folder, "labels"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.score(docs, labels, ["low_quality", "toxic"])
    return found.select(
        "doc_id", F.col("scores")[0].alias("p_low_quality"), F.col("scores")[1].alias("p_toxic"),
        (F.col("scores")[1] >= 0.3).alias("toxic"),
    )


def op4_interleave(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(table(spark, folder, "documents"), 40)


def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents")).drop("text_key")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 512)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    return styletree.extract_main(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, folder, "documents").select("doc_id", "text"), plant=True, full=False)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return found.select("doc_id", *[f"found.{c}" for c in names])


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cover_tree, op2_decontaminate, op3_toxicity, op4_interleave, op5_passages, op6_packing, op7_token_counts,
        op8_warc, op9_line_dedup, op10_simhash, op11_style_tree, op12_periodic_runs, op13_ranked_search, pipeline,
    )
}

SQL = {
    "op1_cover_tree": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings
        ), good AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
              AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), c AS (SELECT a vec_id, min(b) component_id FROM reach GROUP BY a),
        n AS (SELECT a vec_id, count(*) n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
        FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op2_decontaminate": r"""
        WITH fold AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents
        ), item AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 10) size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
            FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0
        ), place AS (
            SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') g
            FROM fold, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) t(i)
        ), met AS (SELECT p.doc_id, p.i, p.size, win.item_id FROM place p JOIN win USING (size, g)),
        words AS (SELECT doc_id, count(DISTINCT k) n FROM met, unnest(range(i, i + size)) t(k) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) n, string_agg(item_id, ',' ORDER BY item_id) s
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM met) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(len(w), 0) n_words, coalesce(words.n, 0)::BIGINT n_hit, coalesce(items.n, 0) n_items,
               sha256(coalesce(s, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
        FROM fold LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
        d AS (SELECT page_id, strlen(html) payload_bytes, sha256(html) payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
               CASE WHEN page_id <> first THEN first END refers_to FROM f
    """,
    "op9_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(text, chr(10)) l FROM documents
        ), line AS (
            SELECT doc_id, i, l[i] x FROM split, unnest(range(1, len(l) + 1)) t(i)
        ), full_line AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) n FROM line WHERE x <> ''
        ), win AS (
            SELECT doc_id, n, [i, lead(i, 1) OVER w, lead(i, 2) OVER w] spots, [x, lead(x, 1) OVER w, lead(x, 2) OVER w] g,
                   lead(i, 2) OVER w IS NOT NULL whole FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY n)
        ), first AS (SELECT g, min((doc_id, n)) f FROM win WHERE whole GROUP BY g),
        gone AS (
            SELECT DISTINCT doc_id, unnest(spots) i FROM win JOIN first USING (g)
            WHERE whole AND (f[1] <> doc_id OR n >= f[2] + 3)
        ), left_over AS (
            SELECT doc_id, string_agg(x, chr(10) ORDER BY i) text FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        ), lost AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(len(l), 0) n_lines, coalesce(n, 0) n_removed,
               CASE WHEN l IS NULL THEN NULL ELSE coalesce(left_over.text, '') END text
        FROM split LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """,
    "op13_ranked_search": r"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents
        ), item AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark
        ), total AS (SELECT count(*) n_docs, sum(len(w))::BIGINT n_words FROM doc WHERE len(w) > 0),
        tf AS (
            SELECT doc_id, 25 + (75 * len(w) * n_docs) // n_words m, t, count(*) tf
            FROM doc, total, unnest(w) u(t) WHERE t IN (SELECT t FROM item) GROUP BY ALL
        ), weight AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM tf, total GROUP BY t, n_docs
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score
            FROM item JOIN tf USING (t) JOIN weight USING (t) GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
}
