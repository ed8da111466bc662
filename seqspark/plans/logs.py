"""Queries of logs, sinks, searches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.functions.storage import folder
from seqspark.operators import filters, select
from seqspark.plans import search
from seqspark.plans.core import rounded
from seqspark.plans.fixtures import fixture
from seqspark.sources import readers, sinks
from seqspark.streaming import live

SPECS: dict[str, tuple] = {}


def spec(name: str, sql: str | None = None):
    def keep(f):
        SPECS[name] = (f, sql)
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    return folder(spark, "search")


@spec("s06_picked_models", "select complex_id, rank_no, relaxed, file, row_number() over (partition by complex_id order by rank_no) model_no from (select *, row_number() over (partition by complex_id, rank_no order by relaxed desc, file) r from (select l_orderkey complex_id, l_linenumber rank_no, l_returnflag='R' relaxed, l_partkey file from {lineitem})) where r=1")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("complex_id"), F.col("l_linenumber").alias("rank_no"), (F.col("l_returnflag") == "R").alias("relaxed"), F.col("l_partkey").alias("file"))
    return readers.picked_models(rows).withColumn("model_no", F.col("model_no").cast("long"))


@spec("s07_best_model", "select complex_id, model_id, row_number() over (partition by complex_id order by coalesce(iptm,0) desc, model_id) place from (select l_orderkey complex_id, l_linenumber model_id, case when l_discount > 0.02 then cast(l_discount as double) end iptm from {lineitem})")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("complex_id"), F.col("l_linenumber").alias("model_id"), F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("double")).alias("iptm"))
    return readers.best_model(rows).select("complex_id", "model_id", F.col("place").cast("long").alias("place"))


@spec("s14_remaining", "select distinct sequence from {peptides} where sequence not in (select sequence from {peptides} where start_pos < 130)")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "peptides")
    return filters.not_evaluated(rows.select("sequence").distinct(), rows.where("start_pos < 130"))


@spec("k02_wide_objectives", "select seq_id, round(max(case when obj='obj1' then mean end),6) obj1, round(max(case when obj='obj2' then mean end),6) obj2 from {predictions_multi} group by seq_id")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fixture(spark, sf_dir, "predictions_multi").withColumnRenamed("mean", "value")
    return rounded(sinks.wide_objectives(long, ["obj1", "obj2"]), "obj1", "obj2")


@spec("k03_widened", "select seq_id, round(mean,6) mean, null::double iptm from {predictions} union all select seq_id, null, round(iptm,6) from {scores}")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = fixture(spark, sf_dir, "predictions").select("seq_id", "mean"), fixture(spark, sf_dir, "scores").select("seq_id", "iptm")
    return rounded(sinks.widened(old, new), "mean", "iptm")


@spec("k09_upsert_exact", "select o_custkey sample_id, o_orderkey%3 cycle_no from {orders} union select o_custkey, o_orderkey%3 from {orders} where o_orderkey % 2 = 0")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = lambda df: df.select(F.col("o_custkey").alias("sample_id"), (F.col("o_orderkey") % 3).alias("cycle_no"))
    return sinks.upsert_exact(part(rows), part(rows.where("o_orderkey % 2 = 0")))


@spec("k10_design_results", "select d.sample_id, d.cycle, length, n_orders, energy from (select o_custkey sample_id, o_orderkey%3 as cycle, count(*) n_orders from {orders} group by 1,2) d left join (select l_suppkey sample_id, l_orderkey%3 as cycle, count(*) energy from {lineitem} group by 1,2) e on d.sample_id=e.sample_id and d.cycle=e.cycle left join (select c_custkey sample_id, c_nationkey length from {customer}) s on s.sample_id=d.sample_id")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    designs = t("orders").groupBy(F.col("o_custkey").alias("sample_id"), (F.col("o_orderkey") % 3).alias("cycle")).agg(F.count("*").alias("n_orders"))
    energies = t("lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_orderkey") % 3).alias("cycle")).agg(F.count("*").alias("energy"))
    return sinks.design_results(designs, energies, t("customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("length")))


@spec("l03_search_candidates")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    scores = rows.select("seq_id", (3 * F.col("embedding")[0] - F.col("embedding")[1]).alias("objective"))
    phases = [search.Phase("standard_deviation", 1), search.Phase("expected_improvement", 2)]
    return search.search_candidates(rows.select("seq_id", "embedding"), search.replay_scorer(scores), phases, _folder(spark))


@spec("l03b_tuned_search")
def l03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with the members nearest to cluster centres, and tunes width and ridge."""
    rows = fixture(spark, sf_dir, "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    scores = rows.select("seq_id", (3 * F.col("embedding")[0] - F.col("embedding")[1]).alias("objective"))
    return search.search_candidates(rows.select("seq_id", "embedding"), search.replay_scorer(scores), [search.Phase("expected_improvement", 2)], _folder(spark), n_initial=20, initial="kmeans", tune_every=2, n_trials=8)


@spec("l05_evolve")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda df: df.withColumn("objective", properties.gravy(F.col("sequence")))
    return search.evolve(_parents_of(spark, sf_dir), score, [search.Phase("upper_confidence_bound", 1), search.Phase("expected_improvement", 1)], _folder(spark), n_initial=60, pool=300, parents=search.Parents("exponential", beta=4.0), n_components=4, tune_every=2, n_trials=6)


@spec("l05b_evolve_objectives")
def l05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objectives, hydropathy up and mass down."""

    def score(df: DataFrame) -> DataFrame:
        both = df.select("sequence", properties.gravy(F.col("sequence")).alias("gravy"), properties.molecular_weight(F.col("sequence")).alias("mass"))
        return both.unpivot("sequence", ["gravy", "mass"], "obj", "value")

    return search.evolve(_parents_of(spark, sf_dir), score, [search.Phase("parego_chebyshev_ucb", 2)], _folder(spark), n_initial=60, pool=300, parents=search.Parents(top=20), directions={"gravy": "max", "mass": "min"})


def _parents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty random ones of all tiles that a search may begin with."""
    return select.random_rows(fixture(spark, sf_dir, "peptides").where("length(sequence) between 5 and 40").select("sequence").distinct(), 50, key="sequence")


@spec("l06_site_scorer", "select r.seq_id, round(cast(count(s.res_idx)+0.001*coalesce(sum(s.res_idx),0) as double),6) objective from (select distinct structure_id seq_id from {atoms}) r left join (select structure_id, res_idx from {site} where structure_id % 2 = 0 union all select structure_id, unnest([1,7,9]) from (select distinct structure_id from {atoms} where structure_id % 2 = 1)) s on s.structure_id=r.seq_id group by 1")
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom score of each row's own site; structures of odd number have none and take the default."""
    sites = fixture(spark, sf_dir, "site").where("structure_id % 2 = 0").withColumnRenamed("structure_id", "seq_id")
    score = lambda df: df.select("seq_id", (F.size("site") + 0.001 * F.aggregate("site", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("objective"))
    rows = fixture(spark, sf_dir, "atoms").select(F.col("structure_id").alias("seq_id")).distinct()
    return rounded(search.site_scorer(score, sites, default=[9, 1, 7])(rows), "objective")


@spec("l09_replay_scorer", "select p.seq_id, round(iptm,6) iptm from {predictions} p join {scores} s on p.seq_id=s.seq_id where in_binding_site")
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixture(spark, sf_dir, "scores").where("in_binding_site").select("seq_id", "iptm")
    return rounded(search.replay_scorer(known)(fixture(spark, sf_dir, "predictions")), "iptm")


def _streamed(spark: SparkSession, rows: DataFrame, transform, mode: str) -> DataFrame:
    """The final state of a stream over a written table, from files: what is appended, or the last batch's whole result."""
    base = _folder(spark)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in").withWatermark("ts", "10 minutes")
    out = transform(stream)
    state = lambda sink: sink.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    if mode == "append":
        state(out.writeStream.format("parquet").option("path", f"{base}/out")).awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")
    last = [None]

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{number}")
        last[0] = number

    state(out.writeStream.foreachBatch(store)).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out-{last[0]}") if last[0] is not None else spark.createDataFrame([], out.schema)


@spec("x02_running_best", "select phase, round(max(objective),6) best, round(min(objective),6) worst, count(*) n from {score_log} group by phase")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_streamed(spark, fixture(spark, sf_dir, "score_log"), live.running_best, "complete"), "best", "worst")


@spec("x03_throughput", "select date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as \"end\", count(*) n, round(avg(objective),6) mean_objective from {score_log} group by 1, 2")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, fixture(spark, sf_dir, "score_log"), live.throughput, "complete")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "mean_objective")


@spec("x04_live_leaderboard", "select row_number() over (order by objective desc, sequence)::int as rank, sequence, round(objective,6) objective from (select sequence, max(objective) objective from {score_log} group by sequence) order by objective desc, sequence limit 10")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, rows = _folder(spark), fixture(spark, sf_dir, "score_log")
    rows.write.parquet(f"{base}/in")
    return rounded(live.live_leaderboard(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/best", 10, f"{base}/state"), "objective")


@spec("x05_streaming_properties", "select seq_id, round(({c})::double/length(sequence),6) hydrophobic_fraction from {{sequences}} where length(sequence) > 0".format(c=f"length(sequence)-length(regexp_replace(sequence,'[{properties.HYDROPHOBIC}]','','g'))"))
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "sequences").where("length(sequence) > 0").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    scored = lambda df: df.select("seq_id", F.round(properties.fraction(F.col("sequence"), properties.HYDROPHOBIC), 6).alias("hydrophobic_fraction"))
    return _streamed(spark, rows, scored, "append")


@spec("x01_live_log", "select distinct sequence, iteration from {score_log}")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    rows = fixture(spark, sf_dir, "score_log").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(rows).write.parquet(f"{base}/in")
    stream = live.score_stream(spark, f"{base}/in", rows.schema, late="3650 days").select("sequence", "iteration")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@spec("l04_search_proteome")
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = fixture(spark, sf_dir, "sequences").withColumnRenamed("seq_id", "protein_id")
    score = lambda df: df.withColumn("objective", properties.gravy(F.col("sequence")))
    return search.search_proteome(proteins, score, [search.Phase("standard_deviation", 1), search.Phase("expected_improvement", 1)], _folder(spark), n_initial=40, pool=150, batch=10)
