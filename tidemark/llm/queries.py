"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixity, language, language_model, licenses, mixing, sentencepieces, simhash, token_counts, topk, vector_dedup

PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = PIECES) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses stated in each document: how many, their names and the best coverage.

    Null and empty texts have none and coverage 0; repeated rows come out each
    time; of equally good stretches the first counts; an empty table gives no row.
    """
    hits = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0))
    return hits.select("doc_id", F.size("hits").alias("n_licenses"), F.array_join(F.transform("hits", lambda h: h["template"]), ",").alias("licenses"), F.round(best, 6).alias("coverage"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every embedding whose vec_id is divisible by 100.

    Ties go to the smaller vec_id; null vectors, ids and components take no
    part, repeated rows are candidates each time, an empty table gives no row.
    """
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among embeddings of a label, as counts and components, a row a row.

    Nulls link with nothing, repeated rows and repeated vec_ids are rows of
    their own, a cosine of just 0.98 links, an empty table gives no row.
    """
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Tokens of every text and digests of its ids and of what they decode to.

    A null text is the empty one, with the end id alone; repeated rows come
    out each time, null doc_ids stay null, nothing ties, an empty table gives no row.
    """
    done = sentencepieces.encode(table(spark, sf_dir, "documents") if docs is None else docs, vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three of four doc_ids.

    `und` for texts that are null or without a letter; a null doc_id is
    neither held out nor learned from; repeated rows are predicted each time;
    equal probabilities go to the first language by code point; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    net, langs = language.fit(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language.identify(docs, net, langs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages that lost, gained, changed and lengthened records.

    Of page ids, those with 7 left over by 50 have another first byte, those
    with 211 by 997 are longer, those with 503 by 997 are lost, and each with
    809 by 997 has a record more under the negative id. Nulls, repeats and
    empty tables as in fixity.located.
    """
    pages = table(spark, sf_dir, "pages")
    p, html = F.col("page_id"), F.col("html")
    changed = F.when((p % 50 == 7) & html.startswith("<"), F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).when(p % 997 == 211, F.concat(html, F.lit("<!-- more -->"))).otherwise(html)
    more = pages.where(p % 997 == 809).withColumn("page_id", -p)
    replica = pages.where(F.coalesce(p % 997 != 503, F.lit(True))).withColumn("html", changed).unionByName(more)
    return fixity.located(pages, replica)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Null and empty texts have fingerprint 0 and link like any other; repeated
    rows come out each time; a component without any doc_id has none; three
    differing bits link, four don't; an empty table gives no row.
    """
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes.

    Null texts have size 0, null sources are one source, null doc_ids and
    repeated rows are mixed as rows; ties as in mixing.mix; an empty table gives no row.
    """
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and exact token count of every text, and whether it is over 4,096 tokens.

    A null text is the empty one, of 0 tokens; 4,096 tokens are not over the
    limit; repeated rows come out each time; an empty table gives no row.
    """
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary()).withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of six of seven doc_ids.

    A null text is the end alone; a null doc_id is neither held out nor
    learned from; repeated rows train and score each time; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_exact_topk, op3_embedding_dedup, op4_sentencepiece, op5_language_id, op6_warc_fixity, op7_simhash, op8_mixing, op9_token_counts, op10_lm_scoring, pipeline)}

ORACLES = {
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             c AS (SELECT vec_id, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM v),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.e * c.e)::BIGINT AS score FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
                   WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
                   WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
             r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
             m AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
        FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_warc_fixity": """
        WITH o AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
             c AS (SELECT page_id, url, CASE WHEN page_id % 50 = 7 AND starts_with(html, '<') THEN '#' || substr(html, 2) WHEN page_id % 997 = 211 THEN html || '<!-- more -->' ELSE html END AS html
                   FROM o WHERE coalesce(page_id % 997 <> 503, TRUE) UNION ALL SELECT -page_id, url, html FROM o WHERE page_id % 997 = 809),
             n AS (SELECT greatest(1, ceil(count(*) / 256))::BIGINT AS files FROM pages),
             r AS (SELECT side, page_id, ('0x' || substr(md5(page_id::VARCHAR), 1, 15))::BIGINT % files AS file, text, octet_length(encode(text))::BIGINT AS length
                   FROM (SELECT side, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
                         || CASE WHEN html IS NULL THEN '' ELSE chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html))::VARCHAR END
                         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS text
                         FROM (SELECT 0 AS side, * FROM o UNION ALL SELECT 1, * FROM c)), n),
             l AS (SELECT side, page_id, file, text, length, row_number() OVER w AS at, (sum(length) OVER w - length)::BIGINT AS "offset"
                   FROM r WINDOW w AS (PARTITION BY side, file ORDER BY page_id ROWS UNBOUNDED PRECEDING)),
             p AS (SELECT a.page_id AS a_id, b.page_id AS b_id, a.file AS a_file, b.file AS b_file, a."offset" AS a_offset, b."offset" AS b_offset, a.length AS a_length, b.length AS b_length,
                          a.text = b.text AS equal, a.at = b.at AS place FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.page_id = b.page_id),
             s AS (SELECT *, CASE WHEN b_id IS NULL THEN 'lost' WHEN a_id IS NULL THEN 'gained' WHEN NOT equal THEN 'changed' WHEN NOT place OR a_offset <> b_offset THEN 'moved' ELSE 'same' END AS status FROM p)
        SELECT coalesce(a_id, b_id) AS page_id, coalesce(a_file, b_file) AS file, coalesce(a_offset, b_offset) AS "offset", coalesce(a_length, b_length) AS length, status <> 'same' AS damaged, status FROM s""",
    "op8_mixing": r"""
        WITH plain AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
             nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM plain),
             sized AS (SELECT doc_id, source, size, copy, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || copy // 256), 1, 15))::BIGINT AS key FROM nth),
             src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY 1),
             ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM src),
             weighed AS (SELECT *, ((rk - 1) % 3 + 1)::BIGINT AS weight FROM ranked),
             filled AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS ws,
                        (sum(3 * source_size) OVER o)::BIGINT - 3 * source_size AS before, (sum(weight) OVER o)::BIGINT - weight AS wbefore
                        FROM weighed WINDOW o AS (ORDER BY source_size * 3 / weight, rk ROWS UNBOUNDED PRECEDING)),
             capped AS (SELECT *, 3 * source_size * (ws - wbefore) <= weight * (total - before) AS cap FROM filled),
             shared AS (SELECT *, (sum(CASE WHEN cap THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT AS fixed, (sum(CASE WHEN cap THEN 0 ELSE weight END) OVER ())::BIGINT AS free FROM capped),
             aimed AS (SELECT source, source_size, rk, CASE WHEN cap THEN (3 * source_size)::DOUBLE ELSE (weight * (total - fixed))::DOUBLE / free END AS target,
                       round(total / 16)::BIGINT AS seats, ceil(sqrt(docs / 16))::BIGINT AS shards FROM shared),
             sq AS (SELECT source, rk, seats, target / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, seats)) AS k FROM aimed WHERE target > 0)),
             sr AS (SELECT source, row_number() OVER (ORDER BY q DESC, rk) AS r, seats FROM sq),
             quota AS (SELECT source, count(*) AS quota FROM sr WHERE r <= seats GROUP BY 1),
             placed AS (SELECT d.*, a.source_size, a.target, d.key % a.shards AS shard, coalesce(q.quota, 0) AS quota
                        FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
             sh AS (SELECT source, shard, any_value(quota) AS seats, sum(size)::BIGINT AS words FROM placed GROUP BY 1, 2),
             hq AS (SELECT source, shard, seats, words / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, seats)) AS k FROM sh WHERE words > 0)),
             hr AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM hq),
             hw AS (SELECT source, shard, count(*) AS won FROM hr WHERE r <= seats GROUP BY 1, 2),
             plan AS (SELECT sh.source, sh.shard, ceil(words / 16)::BIGINT AS n, least(coalesce(won, 0), 3 * ceil(words / 16)::BIGINT)::BIGINT AS q,
                      ('0x' || substr(md5('17:' || coalesce(sh.source, '') || ':' || sh.shard::VARCHAR), 1, 15))::BIGINT % ceil(words / 16)::BIGINT AS start
                      FROM sh LEFT JOIN hw ON sh.source IS NOT DISTINCT FROM hw.source AND sh.shard = hw.shard WHERE words > 0),
             laid AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size, copy ROWS UNBOUNDED PRECEDING))::BIGINT AS b FROM placed),
             cut AS (SELECT l.*, n, q // n AS passes, q % n AS rest, start, b - size AS a FROM laid l LEFT JOIN plan p ON l.source IS NOT DISTINCT FROM p.source AND l.shard = p.shard)
        SELECT doc_id, size, source_size, target, coalesce(
               (passes * b + 16 * ((b // 16 * rest + start) // n) + b % 16 * (((b // 16 + 1) * rest + start) // n - (b // 16 * rest + start) // n))
             - (passes * a + 16 * ((a // 16 * rest + start) // n) + a % 16 * (((a // 16 + 1) * rest + start) // n - (a // 16 * rest + start) // n)), 0)::BIGINT AS taken FROM cut""",
}
