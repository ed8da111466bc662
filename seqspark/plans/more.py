"""Queries of sites, residue lookups, tables of properties, sampling and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import properties
from seqspark.functions.exprs import count_letters, normal
from seqspark.operators import cluster, filters, generate, overlap, select
from seqspark.plans.core import PEPTIDES, _count, _peptides, rounded
from seqspark.plans.fixtures import fixture
from seqspark.sources import readers

SPECS: dict[str, tuple] = {}


def spec(name: str, sql: str | None = None):
    def keep(f):
        SPECS[name] = (f, sql)
        return f

    return keep


_CHAINS = "(select structure_id, count(*) n_residues, 5 as start from {residues} where chain='A' group by 1)"


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chains = fixture(spark, sf_dir, "residues").where("chain = 'A'").groupBy("structure_id").agg(F.count("*").alias("n_residues")).withColumn("start", F.lit(5))
    return fixture(spark, sf_dir, "site"), chains


@spec("f05_normalised_sites", f"select s.structure_id, s.res_idx-c.start+1 res_idx from {{site}} s join {_CHAINS} c on s.structure_id=c.structure_id")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, chains = _site(spark, sf_dir)
    return filters.normalised_sites(sites, chains, zero_indexed=True).withColumn("res_idx", F.col("res_idx").cast("long"))


_LETTER = "substr('ACDEFGHIKLMNPQRSTVWY', cast(1+res_idx%20 as int), 1)"


@spec("f06_site_windows", f"select s.structure_id, s.res_idx site_idx, string_agg(case when r.res_idx=s.res_idx then '['||aa||']' else aa end, '' order by r.res_idx) context from {{site}} s join (select structure_id, res_idx, {_LETTER} aa from {{residues}} where chain='A') r on r.structure_id=s.structure_id and r.res_idx between s.res_idx-5 and s.res_idx+5 group by 1,2")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = fixture(spark, sf_dir, "residues").where("chain = 'A'").select("structure_id", "res_idx", F.expr(_LETTER).alias("aa"))
    return filters.site_windows(fixture(spark, sf_dir, "site"), letters)


@spec("f08_with_previous", "select seq_id, 'old' origin from {scores} where iptm > 0.4 union all select seq_id, 'new' from {predictions} where seq_id not in (select seq_id from {scores} where iptm > 0.4)")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fixture(spark, sf_dir, "scores").where("iptm > 0.4").select("seq_id", F.lit("old").alias("origin"))
    return filters.with_previous(fixture(spark, sf_dir, "predictions").select("seq_id"), old, lambda new: new.withColumn("origin", F.lit("new")), "seq_id")


@spec("f09_available_scores", "select complex_id, string_agg(score, ',' order by score) scores from (select seq_id complex_id, in_binding_site site, iptm > 0.3 template from {scores}), (values ('iptm',false,false),('in_site',true,false),('rmsd',false,true),('site_rmsd',true,true)) c(score,a,b) where (not a or site) and (not b or template) group by 1")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame([("iptm", False, False), ("in_site", True, False), ("rmsd", False, True), ("site_rmsd", True, True)], "score string, needs_site boolean, needs_template boolean")
    complexes = fixture(spark, sf_dir, "scores").select(F.col("seq_id").alias("complex_id"), F.col("in_binding_site").alias("has_site"), (F.col("iptm") > 0.3).alias("has_template"))
    return overlap.available_scores(catalog, complexes).select("complex_id", F.array_join("scores", ",").alias("scores"))


@spec("f13_without_failures", "select seq_id from {predictions} where std is not null")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "predictions").select("seq_id", F.when(F.col("std").isNull(), "no spread").alias("error"))
    return filters.without_failures(rows)


@spec("s11_property_table", "select property, aa, value from (select l_linenumber::varchar property, 'A' aa, round(avg(l_quantity),6) as value from {lineitem} group by 1 union all select l_linenumber::varchar, 'C', round(avg(l_tax),6) from {lineitem} group by 1)")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").cast("string").alias("property")).agg(F.avg("l_quantity").alias("A"), F.avg("l_tax").alias("C"))
    return rounded(readers.property_table(wide), "value")


@spec("w09_cluster_picks")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_picks(fixture(spark, sf_dir, "vectors"), 10)


def _spread_sql(k: int) -> str:
    """Picks one after the other, each the first arrival of the squared distances from the nearest pick."""
    parts = ["v as (select seq_id, embedding::double[] e from {vectors})", "s1 as (select seq_id, e from v order by {U:seq_id,0}, seq_id limit 1)", "n1 as (select v.seq_id, v.e, list_distance(v.e, s1.e) m from v, s1)"]
    for i in range(2, k + 1):
        before = " union ".join(f"select seq_id from s{j}" for j in range(1, i))
        parts.append(f"s{i} as (select seq_id, e from n{i - 1} where seq_id not in ({before}) order by case when m > 0 then -ln({{U:seq_id,{i - 1}}})/(m*m) end nulls last, seq_id limit 1)")
        parts.append(f"n{i} as (select n.seq_id, n.e, least(n.m, list_distance(n.e, s{i}.e)) m from n{i - 1} n, s{i})")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select {i} as rank, seq_id from s{i}" for i in range(1, k + 1))


@spec("w10_spread_picks", _spread_sql(5))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return select.spread_picks(rows, 5)


@spec("w14_ranked_trials", "select trial from (select seq_id trial from {predictions} order by round(mean,6), seq_id limit 5) union all select seq_id from {scores} where iptm > 0.6")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = fixture(spark, sf_dir, "predictions").select(F.col("seq_id").alias("trial"), F.round("mean", 6).alias("score"))
    return select.ranked_trials(trials, fixture(spark, sf_dir, "scores").where("iptm > 0.6").select(F.col("seq_id").alias("trial")))


@spec("c05_peptide_length", "select seq_id, greatest(7,least(20,trunc(13.5+(13.0/6)*sqrt(-2*ln({U:seq_id,'a'}))*cos(2*pi()*{U:seq_id,'b'}))))::int as size from {predictions}")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "predictions").select("seq_id", generate.peptide_length(42, 7, 20, "seq_id", gaussian=True).alias("size"))


@spec("c11_down_sampled", "select seq_id from {vectors} order by {U:seq_id}, seq_id limit 500")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.random_rows(fixture(spark, sf_dir, "vectors"), 500).select("seq_id")


_NOISE = "sqrt(-2*ln({U:sequence,'a'}))*cos(2*pi()*{U:sequence,'b'})"


@spec("l10_composition_scorer", f"select sequence, round(greatest(0,least(1,0.02*length(sequence)+0.05*{_count(properties.POSITIVE)}-0.03*{_count(properties.HYDROPHOBIC)}+0.05*{_NOISE})),6) objective from {PEPTIDES}")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    value = 0.02 * F.length(s) + 0.05 * count_letters(s, properties.POSITIVE) - 0.03 * count_letters(s, properties.HYDROPHOBIC) + 0.05 * normal(42, "sequence")
    return _peptides(spark, sf_dir).select("sequence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("objective"))
