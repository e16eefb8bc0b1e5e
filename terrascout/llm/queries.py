"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascout.llm import (balance, bpe_counts, embed_dedup, hard_negatives, html_text, jaccard, ogg, phrases, sp_dropout, spelling,
                            suffix_dedup, topk, toxicity)
from terrascout.llm.common import table, text_key


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of documents, learned from labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of documents under the lower-casing word vocabulary."""
    return bpe_counts.token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without what a smaller document's 50-byte strings cover."""
    cleaned = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded with merge-dropout and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text_key().alias("text_sha256"))
    made = sp_dropout.encode(docs, keep=["text_sha256"]).withColumn("n_ids", F.size("ids"))
    back = sp_dropout.decode(made, keep=["text_sha256", "n_ids"])
    decoded = F.sha2("text", 256)
    return back.select("doc_id", "n_ids", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("lossless"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as Ogg and read back."""
    return ogg.inspect(ogg.media(table(spark, sf_dir, "documents"))).drop("error")


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without words of 20-word windows that occurred before."""
    cleaned = phrases.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 and 150 % of all words."""
    mixed = balance.mix(table(spark, sf_dir, "documents"), (5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every 20th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0, 20, scale=64.0)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles are linked at 75 %."""
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts of documents with their more usual spelling."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.pmod("id", F.lit(50)) == 0)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors of one label linked at a cosine of 0.98."""
    return embed_dedup.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_suffix_dedup, op4_merge_dropout, op5_media, op6_phrases, op7_html_text, op8_mix, op9_top_k,
    op10_jaccard, op11_spelling, op12_hard_negatives, op13_near_vectors)}

ORACLES = {
    "op9_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as c
                   from embeddings where vec_id is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, t.vec_id as vec_id,
                     cast(list_sum(list_transform(list_zip(q.c, t.c), lambda p: p[1] * p[2])) as bigint) as score
              from v q join v t on t.vec_id <> q.vec_id and len(t.c) = len(q.c) where q.vec_id % 20 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op12_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
                   from embeddings where vec_id is not null and label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, t.vec_id, a.label = t.label as same,
                     cast(list_sum(list_transform(list_zip(a.c, t.c), lambda p: p[1] * p[2])) as bigint) as score
              from v a join v t on t.vec_id <> a.vec_id and len(t.c) = len(a.c) where a.vec_id % 50 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score,
                     row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same),
        r as (select p.anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
                     cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank
              from p join s on s.anchor_id = p.anchor_id and not same
                and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score where n <= 5)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 3""",
    "op13_near_vectors": """
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as c
                   from embeddings where label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                     and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select a.vec_id as a, b.vec_id as b from v a join v b
                  on a.label = b.label and a.vec_id <> b.vec_id and len(a.c) = len(b.c) where list_cosine_similarity(a.c, b.c) >= 0.98),
        reach(vec_id, other) as (select vec_id, vec_id from embeddings
                                 union select r.vec_id, l.b from reach r join links l on l.a = r.other),
        n as (select a, count(*) as n_links from links group by a),
        c as (select vec_id, min(other) as component_id from reach group by vec_id)
        select e.vec_id, coalesce(n_links, 0) as n_links, component_id, e.vec_id = component_id as kept
        from embeddings e join c using (vec_id) left join n on n.a = e.vec_id""",
}
