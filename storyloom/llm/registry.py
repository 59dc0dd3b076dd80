"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import runtime_filter, scratch_path, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, weak-label posterior, scorer's score and decision for each document."""
    from storyloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each conversation: prompt, completions and their trained spans (start-end). Rejected is the conversation
    with one assistant turn, anywhere in it, gone stale; the common prefix is found, not given."""
    from storyloom.llm.preferences import format_pairs, with_stale_reply

    found = format_pairs(with_stale_reply(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return found.select(
        F.col("key").alias("conv_id"), "common_turns", "prompt", "chosen", spans("chosen_spans").alias("chosen_spans"), "rejected", spans("rejected_spans").alias("rejected_spans")
    )


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good; background: all documents. Where the labels are too many for a broadcast, the
    join that finds the target moves the documents that pass a Bloom filter of the good ids, not all of them."""
    from storyloom.llm.xent import cross_entropy_difference

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    with runtime_filter(spark, good.count()):
        return cross_entropy_difference(docs, docs.join(good, "doc_id", "left_semi"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and decision for each document."""
    from storyloom.llm.toxicity import severity

    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item found in it; documents without a row are clean."""
    from storyloom.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`; the method keeps no groups together."""
    from storyloom.llm.sharding import stratified_shards

    placed = stratified_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        F.col("id").alias("doc_id"),
        (F.col("bytes") + 8).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and round trip for each document, equal to the library's."""
    from storyloom.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back and verified: a row for each page."""
    from storyloom.llm.warc import read_archives, write_archives

    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each vector whose id is divisible by 20, among all others."""
    from storyloom.llm.multiindex import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept for each document, links at a similarity of 0.85."""
    from storyloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_preferences": op2_preferences,
        "op3_cross_entropy": op3_cross_entropy,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_stratified_shards": op6_stratified_shards,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_warc": op8_warc,
        "op9_neighbours": op9_neighbours,
        "op10_near_duplicates": op10_near_duplicates,
    }


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
w AS (SELECT h, max(page_id) AS winner FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN w.winner <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.winner <> d.page_id THEN w.winner END AS refers_to, NULL::VARCHAR AS problem
FROM d LEFT JOIN w ON d.h = w.h AND d.n >= 1000
"""


OP2_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n,
                  coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, n, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY n), first_text) AS stale, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k, count(*) OVER (PARTITION BY conv_id) AS m
      FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY n) AS first_text FROM t) WHERE role = 'assistant'),
s AS (SELECT conv_id, n, stale FROM a WHERE k = ('0x' || left(md5(conv_id::VARCHAR), 8))::BIGINT % m + 1),
r AS (SELECT t.conv_id, t.n, t.role, t.text, CASE WHEN t.n = s.n THEN s.stale ELSE t.text END AS other FROM t LEFT JOIN s USING (conv_id)),
d AS (SELECT conv_id, coalesce(min(n) FILTER (text <> other) - 1, max(n)) AS common FROM r GROUP BY 1),
x AS (SELECT conv_id, n, role, common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS o FROM r JOIN d USING (conv_id)),
y AS (SELECT *, sum(CASE WHEN n > common THEN length(c) ELSE 0 END) OVER w AS ce, sum(CASE WHEN n > common THEN length(o) ELSE 0 END) OVER w AS oe FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY n))
SELECT conv_id, any_value(common)::INTEGER AS common_turns, coalesce(string_agg(c, '' ORDER BY n) FILTER (n <= common), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY n) FILTER (n > common), '') AS chosen,
       coalesce(string_agg((ce - length(c) + 14) || '-' || ce, ' ' ORDER BY n) FILTER (n > common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(o, '' ORDER BY n) FILTER (n > common), '') AS rejected,
       coalesce(string_agg((oe - length(o) + 14) || '-' || oe, ' ' ORDER BY n) FILTER (n > common AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY 1
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_preferences": OP2_SQL, "op8_warc": OP8_SQL, "op10_near_duplicates": OP10_SQL}
