"""The operators' registered queries, each over its whole table, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import exact_dedup, langid, mixing, near_dedup, packing, paragraphs, quality, resampling, secret_scan, token_counts, topk, toxicity, wand
from quillet.llm.common import new_path, table


#: Fixed value: the end-of-text id of word_bpe_49k.json.
END_OF_TEXT = 49407


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix(table(spark, sf_dir, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.clusters(table(spark, sf_dir, "documents")).drop("whole")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.QualityModel.train(docs).score(docs)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.LanguageModel.train(docs.where(~out).select("doc_id", "text", "lang"))
    return model.score(docs).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = token_counts.flat_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT)
    counted = token_counts.count_tokens(blocks, END_OF_TEXT)
    return counted.join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "tokens")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.components(table(spark, sf_dir, "documents"), words=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.ToxicityModel.train(docs.where(~out), table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic"))
    found = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return model.score(docs).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), found.alias("spans"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_mixing": op2_mixing,
        "op3_paragraphs": op3_paragraphs,
        "op4_quality": op4_quality,
        "op5_secret_scan": op5_secret_scan,
        "op6_language": op6_language,
        "op7_topk": op7_topk,
        "op8_token_counts": op8_token_counts,
        "op9_near_dedup": op9_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_toxicity": op11_toxicity,
        "op12_ranked_search": op12_ranked_search,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_near_dedup": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
            e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
            ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
            r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, ways.b FROM r JOIN ways ON ways.a = r.seen)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
            FROM documents d JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
        """,
        "op7_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
                WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
            )
            SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
            WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
        """,
        "op10_exact_dedup": r"""
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            WINDOW w AS (PARTITION BY text_sha256)
        """,
        "op12_ranked_search": r"""
            WITH d AS (SELECT row_number() OVER () AS n, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
            q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            len AS (SELECT n, doc_id, count(*) AS size FROM d GROUP BY 1, 2),
            a AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS total FROM len),
            m AS (SELECT n, doc_id, 25 + (75 * size * docs) // total AS m FROM len, a),
            tf AS (SELECT n, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
            w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, docs),
            s AS (SELECT item_id, n, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (n) GROUP BY 1, 2, 3)
            SELECT item_id, CAST(row_number() OVER v AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
            WINDOW v AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
        """,
        "op13_resampling": r"""
            WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) AS t),
            d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
            f AS (SELECT n, unnest(w) AS w FROM d),
            words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM q)),
            h AS (SELECT w, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: CAST('0x' || substr(x, CAST(i AS INTEGER) + 1, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS k FROM words, tab),
            s AS (SELECT k, count(*) AS c FROM f JOIN h USING (w) GROUP BY k),
            t AS (SELECT k, count(*) AS c FROM q JOIN h USING (w) GROUP BY k),
            g AS (SELECT b.k, CAST(floor(1000 * ln((coalesce(t.c, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE) / ((coalesce(s.c, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM q) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
                  FROM (SELECT unnest(range(10000)) AS k) b LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
            m AS (SELECT n, count(*) AS c, sum(gain) AS total FROM f JOIN h USING (w) JOIN g USING (k) GROUP BY n),
            v AS (SELECT doc_id, d.n, coalesce(m.c, 0) AS n_features, CAST(floor(coalesce(total, 0) / coalesce(m.c, 1)) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (n)),
            z AS (SELECT doc_id, n, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM v),
            r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM z WHERE n_features >= 20)
            SELECT doc_id, n_features, weight, score, CASE WHEN rank <= many * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (n)
        """,
    }
