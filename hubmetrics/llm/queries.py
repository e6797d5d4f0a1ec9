"""One query per operator on the driver's tables, and the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubmetrics.llm.common import table
from hubmetrics.llm.decontamination import contamination
from hubmetrics.llm.embed_dedup import similar_vectors
from hubmetrics.llm.importance import importance_resample
from hubmetrics.llm.lexical import lexical_search
from hubmetrics.llm.licenses import license_scan
from hubmetrics.llm.lm import lm_held_out
from hubmetrics.llm.ngram_join import ngram_components
from hubmetrics.llm.packing import packed
from hubmetrics.llm.piece_bpe import encode_pieces
from hubmetrics.llm.quality import quality_scores
from hubmetrics.llm.token_counts import token_counts
from hubmetrics.llm.toxicity import fit_toxicity, toxicity_scores
from hubmetrics.llm.warc import read_warc, write_warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(sql=r"""
    WITH RECURSIVE word AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    shingle AS (
        SELECT DISTINCT r, array_to_string(w[s : s + 2], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM word WHERE len(w) > 0)),
    size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
    link AS (
        SELECT a.r AS x, b.r AS y
        FROM shingle a JOIN shingle b USING (g) JOIN size m ON m.r = a.r JOIN size k ON k.r = b.r
        WHERE a.r <> b.r GROUP BY a.r, b.r, m.n, k.n HAVING 100 * count(*) >= 90 * (m.n + k.n - count(*))),
    reach AS (SELECT r AS x, r AS y FROM word UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
    SELECT word.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
    FROM word LEFT JOIN size USING (r)
    JOIN (SELECT x AS r, min(o.doc_id) AS c FROM reach JOIN word o ON o.r = reach.y GROUP BY x) USING (r)""")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90).drop("kept", "_row")


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens of the 49k word vocabulary."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of four folds of five."""
    return lm_held_out(table(spark, sf_dir, "documents"))


@query(sql="""
    WITH page AS (
        SELECT page_id, coalesce(html, '') AS p, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages),
    named AS (
        SELECT *, array_to_string([
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
                + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)
            FOR i IN range(32)], '') AS digest,
            min(page_id) OVER (PARTITION BY p) AS least
        FROM page)
    SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> least THEN least END AS refers_to
    FROM named""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by its place in the index."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return read_warc(write_warc(pages)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_scan(table(spark, sf_dir, "documents"))


@query()
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a cosine of 0.95 or more, found by E8 lattice hashing."""
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from weak labels; no given label is read."""
    return quality_scores(table(spark, sf_dir, "documents")).drop("_row")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("_row")


@query(sql=r"""
    WITH doc AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    item AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    item_window AS (
        SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, least(10, len(w)) AS k FROM item) WHERE k > 0)),
    doc_window AS (
        SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s
              FROM doc, (SELECT DISTINCT k FROM item_window))),
    hit AS (SELECT r, s, k, item FROM doc_window JOIN item_window USING (k, g)),
    place AS (
        SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM hit)) GROUP BY r),
    named AS (
        SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS d
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(d, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN place USING (r) LEFT JOIN named USING (r)""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a run of ten words of a benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


@query(sql=r"""
    WITH doc AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    total AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc),
    asked AS (
        SELECT item_id, i, t, count(*) AS times
        FROM (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
              FROM benchmark)
        GROUP BY ALL),
    found AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
    weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, total GROUP BY t, n),
    scored AS (
        SELECT i, item_id, r, doc_id, CAST(sum(times * weight.w
            * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(doc.w) * n) // l))))) AS BIGINT) AS score
        FROM asked JOIN weight USING (t) JOIN found USING (t) JOIN doc USING (r), total
        GROUP BY i, item_id, r, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0)
    SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 20""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of five per cent of the documents, weighted towards the benchmark's texts."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the 32k piece vocabulary, and the text that they decode to."""
    both = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
