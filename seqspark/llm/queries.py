"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import ann, ball_tree, bpe, fim, importance, kn_lm, lang_id, mixing, near_dup, pieces, token_store, toxicity, vectors, warc
from seqspark.llm.common import crc_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), last=1)
    return token_store.read_tokens(manifest)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams. A block of texts opens each bucket that its words fall in; the README has figures."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_of_id() % 10 == 0
    model = kn_lm.count_ngrams(docs.where(~held), order=2)
    return kn_lm.score_texts(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: their language and quality."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.where("lang is not null").select("doc_id", "lang").join(quality, "doc_id").select("doc_id", F.concat_ws("-", F.col("lang"), F.col("quality").cast("string")).alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixer = mixing.fit_mixture(docs, domain_labels(docs, _table(spark, sf_dir, "labels")))
    names = F.array(*map(F.lit, mixer.domains))
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return mixing.document_rates(mixer).select("doc_id", "n_tokens", F.element_at(names, likeliest).alias("domain"), F.round(F.array_max("posterior"), 6).alias("posterior"), F.round("rate", 6).alias("rate"), "copies")


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ball_tree.quantised(vectors.valid_vectors(_table(spark, sf_dir, "embeddings")))
    return ball_tree.top_inner_products(x, x.where("vec_id % 50 = 0"), k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_of_id() % 4 == 2
    model = lang_id.fit_languages(docs.where(~held))
    return lang_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits 13 of 16 parts. On nearly isotropic vectors, as the given ones are, neighbours lie in nearly all parts, so the search is near-exhaustive there; see the README for fewer."""
    x = vectors.valid_vectors(_table(spark, sf_dir, "embeddings"), zero_too=False)
    router = ann.fit_partitions(x)
    return ann.approximate_neighbours(x, x.where("vec_id % 20 = 0"), router, k=20, probes=ann.probes_of(router))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    encoded = pieces.piece_encode(_table(spark, sf_dir, "documents"), model, last=2)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    summed = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return pieces.piece_decode(summed, model, ["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents"), percent=90, suffix_first=20, seed=1)
    again = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, buckets=10_000, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_store, op2_lm_score, op3_warc, op4_mixing, op5_top_products, op6_toxicity, op7_near_duplicates, op8_language, op9_neighbours, op10_bpe, op11_sentencepiece, op12_fill_in_middle, op13_importance, pipeline)
}

# A draw is the k-th eight digits of a digest; DuckDB's lists of units give the cuts.
_H = [f"cast('0x'||substr(sha256('1:'||coalesce(doc_id::varchar,'')),{8 * k + 1},8) as bigint)" for k in range(4)]
ORACLE_SQL: dict[str, str] = {
    "op12_fill_in_middle": f"""with u as (select doc_id, coalesce(text,'') t, regexp_extract_all(coalesce(text,''), '[A-Za-z]+|[^A-Za-z]') l, {_H[0]} h1, {_H[1]} h2, {_H[2]} h3, {_H[3]} h4 from documents),
        c as (select *, len(l) n, least(h1%(len(l)+1), h2%(len(l)+1)) a, greatest(h1%(len(l)+1), h2%(len(l)+1)) b from u),
        p as (select doc_id, t, n, array_to_string(l[1:a],'') pre, array_to_string(l[a+1:b],'') mid, array_to_string(l[b+1:],'') suf,
            case when t='' or contains(t,'<P>') or contains(t,'<S>') or contains(t,'<M>') or h3%100>=90 then 'plain' when h4%100<20 then 'spm' else 'psm' end form from c)
        select doc_id, n, form, case when form<>'plain' then length(pre) end prefix_chars, case when form<>'plain' then length(mid) end middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>'||pre||'<S>'||suf||'<M>'||mid else '<S>'||suf||'<P>'||pre||'<M>'||mid end) output_sha256, sha256(t) restored_sha256 from p"""
}
