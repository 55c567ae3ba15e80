"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def tokenizer_path() -> str:
    """The vocabulary file that the queries use: from the installed tokenizer files, else its usual place."""
    try:
        import public_tokenizers
    except ImportError:
        return TOKENIZER
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import bpe

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = bpe.encode(docs, tokenizer_path(), decode=True, ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import quality

    docs, labels = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import secrets

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import token_counts

    return token_counts.limit_table(token_counts.length_histogram(spread(read_table(spark, sf_dir, "documents").select("text")), tokenizer_path()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import toxicity

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("unwanted"), "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels, ("unwanted", "toxic")))
    return scored.select("doc_id", "p_unwanted", "p_toxic", (F.col("p_toxic") >= toxicity.REJECT_FROM).alias("toxic"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_join import jaccard_components

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return jaccard_components(docs, shingle=4, percent=85).withColumnRenamed("id", "doc_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.embedding_dedup import near_duplicates

    return near_duplicates(spread(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))).withColumnRenamed("id", "vec_id")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_extract import extract_pages

    return extract_pages(spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))).drop("html")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import dedup_lines

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contaminated, find_benchmark_windows

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_benchmark_windows(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

_SPACES = r"'[\x20\x09-\x0D]'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    # By the shingles that pairs share.
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT rn, array_to_string(list_slice(w, k, k + least(4, len(w)) - 1), ' ') AS s
               FROM (SELECT rn, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT rn, count(*) AS c FROM sh GROUP BY rn),
        both_ AS (SELECT a.rn AS a, b.rn AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.rn <> b.rn GROUP BY a.rn, b.rn),
        links AS (SELECT a, b FROM both_ JOIN n x ON x.rn = a JOIN n y ON y.rn = b WHERE 100 * m >= 85 * (x.c + y.c - m)),
        reach AS (SELECT rn AS a, rn AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a AS rn, min(w.doc_id) AS component_id FROM reach JOIN d w ON w.rn = b GROUP BY a)
        SELECT doc_id, coalesce(c, 0) AS n_shingles, component_id FROM d JOIN comp USING (rn) LEFT JOIN n USING (rn)""",
    # By brute force over all pairs of different vectors; only for tables as small as the SQL check's.
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS rn, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        fine AS (SELECT * FROM v WHERE len(e) > 0 AND len([c for c in e if c IS NULL OR NOT isfinite(c)]) = 0 AND list_sum([abs(c) for c in e]) > 0),
        links AS (SELECT a.rn AS a, b.rn AS b FROM fine a JOIN fine b ON a.rn <> b.rn AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT rn AS a, rn AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a AS rn, min(w.vec_id) AS component_id FROM reach JOIN v w ON w.rn = b GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = v.rn) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN comp USING (rn)""",
    "op9_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT rn, doc_id, string_split(text, chr(10)) AS parts FROM docs),
        lines AS (SELECT rn, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM split),
        keyed AS (SELECT *, {_KEY} AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY rn""",
    "op10_decontaminate": f"""
        WITH dw AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        pats AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(13, len(w)) - 1) AS p, least(13, len(w)) AS m
                 FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT m FROM pats),
        wins AS (SELECT rn, k, m, list_slice(w, k, k + m - 1) AS p
                 FROM (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw JOIN sizes ON len(w) >= m)),
        hits AS (SELECT rn, k, w.m, item_id FROM wins w JOIN pats USING (p)),
        per_word AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(k, k + m)) AS pos FROM hits) GROUP BY rn),
        per_item AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                     FROM (SELECT DISTINCT rn, item_id FROM hits) GROUP BY rn)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN per_word USING (rn) LEFT JOIN per_item USING (rn)""",
}
