"""One thin query per operator, each over its whole table; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import bpe, chat_format, decontam, html_extract, importance, lang_id, license_scan, line_dedup, media, minhash, negatives, suffix_dedup, toxicity
from loomgrid.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.identify(pages, docs).drop("posterior")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs)
    n_bytes = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each vector of ``embeddings`` is drawn as one."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")  # as their descriptors are written
    return media.copies(media.render_vectors(vectors)).withColumnRenamed("image_id", "vec_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN)
    digests = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return bpe.decode(digests, "ids", ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=2, threshold=0.8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("matches")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair(table(spark, sf_dir, "conversations"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10, least_words=20, seed=2024, buckets=10_000, longest=1)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label in seven is moved on by one, as noise."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_media_copies": op3_media_copies,
    "op4_bpe": op4_bpe,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_chat_format": op10_chat_format,
    "op11_importance": op11_importance,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

_WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"

_WHITE = r"[\x20\x09-\x0D]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s
              FROM (SELECT doc_id, h, unnest(generate_series(0, strlen(h) // 2 - 50)) AS k FROM d WHERE strlen(h) >= 100)),
        c AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
        e AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM c),
        r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b
              FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM e) GROUP BY doc_id, run),
        kept AS (SELECT doc_id, any_value(h) AS h, sum(b - a) AS gone, count(a) AS spans, coalesce(max(b), 0) AS tail,
                        coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS head
                 FROM (SELECT d.doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS before
                       FROM d LEFT JOIN r ON r.doc_id = d.doc_id) GROUP BY doc_id)
        SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, spans AS n_spans,
               sha256(unhex(head || substr(h, 2 * tail + 1))) AS kept_sha256
        FROM kept
    """,
    "op5_minhash": f"""
        WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '{_WHITE}'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM dw WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
        FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op7_license_scan": license_scan.scan_sql(),
    "op10_chat_format": chat_format.repair_sql(),
    "op11_importance": importance.resample_sql(),
    "op12_hard_negatives": negatives.mine_sql(),
    "op13_line_dedup": line_dedup.drop_repeated_lines_sql(),
    "op8_decontamination": f"""
        WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        item AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE w <> ['']),
        ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
                FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM item)),
        n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
        dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
                FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                      FROM dw, (SELECT DISTINCT k FROM item) WHERE w <> [''] AND len(w) >= k))
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
        FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_item)
    """,
}
