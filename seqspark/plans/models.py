"""Queries of superposed models and of joined scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import contacts, overlap
from seqspark.plans.core import OBJECTIVES, _objectives, rounded
from seqspark.plans.fixtures import fixture

SPECS: dict[str, tuple] = {}


def spec(name: str, sql: str | None = None):
    def keep(f):
        SPECS[name] = (f, sql)
        return f

    return keep


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each structure: turned, moved and shaken a little."""
    atoms = fixture(spark, sf_dir, "atoms").withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    a, shake = 0.3 * F.col("model"), 0.1 * F.col("model") * F.sin(F.col("vec_id"))
    return atoms.select("structure_id", "model", "chain", "res_idx", (F.col("x") * F.cos(a) - F.col("y") * F.sin(a) + F.col("model") + shake).alias("x"), (F.col("x") * F.sin(a) + F.col("y") * F.cos(a)).alias("y"), F.col("z"))


@spec("j15_superposed_rmsd")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap.superposed_rmsd(_models(spark, sf_dir), fixture(spark, sf_dir, "atoms").drop("vec_id")), "rmsd")


@spec("j17_intra_model_rmsd")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap.intra_model_rmsd(_models(spark, sf_dir)), "mean_rmsd")


_MODELS = "(select structure_id*10+m as id, structure_id, m as model, chain, res_idx, x*cos(0.3*m)-y*sin(0.3*m)+m+0.1*m*sin(vec_id) x, x*sin(0.3*m)+y*cos(0.3*m) y, z from {atoms}, (values (1),(2),(3)) v(m))"
_NEAR = f"(select distinct a.id, a.structure_id, a.model, a.res_idx from {_MODELS} a join {_MODELS} b on a.id=b.id where a.chain='A' and b.chain='B' and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 6.0)"


@spec("j05_models_in_site", f"select structure_id, round(avg(flag::int),6) share, max(case when model=1 then flag::int end) = 1 top, coalesce(max(case when model=1 and flag then n end),0) top_contacts, count(*) n_models from (select m.structure_id, m.model, coalesce(n,0) n, coalesce(n,0) >= 12 flag from (select distinct structure_id, model from {_MODELS}) m left join (select c.structure_id, c.model, count(*) n from {_NEAR} c join {{site}} s on s.structure_id=c.structure_id and s.res_idx=c.res_idx group by 1,2) h on h.structure_id=m.structure_id and h.model=m.model) group by 1")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _models(spark, sf_dir).withColumn("id", F.col("structure_id") * 10 + F.col("model"))
    site = fixture(spark, sf_dir, "site").select(F.explode(F.array(*(F.col("structure_id") * 10 + m for m in (1, 2, 3)))).alias("structure_id"), "res_idx")
    flags = contacts.in_site(models.drop("structure_id").withColumnRenamed("id", "structure_id"), site, 12, cutoff=6.0)
    flags = flags.select(F.floor(F.col("structure_id") / 10).alias("structure_id"), (F.col("structure_id") % 10).alias("model"), "in_site", "n_in_site")
    return rounded(overlap.models_in_site(flags), "share")


@spec("j16_inter_model_rmsd")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best models of two methods, one laid on the other: of three models each method has its own best."""
    models = _models(spark, sf_dir)
    return rounded(overlap.inter_model_rmsd(models.where("model = 1"), models.where("model = 3")), "rmsd")


_LONG = "(select seq_id, case when in_binding_site then 'one' else 'two' end m, round(iptm,6) iptm from {scores} union all select seq_id, 'two', round(iptm,6) from {scores} where iptm > 0.3 and in_binding_site)"


@spec("j18_aliased_scores", f"select seq_id, max(case when m='one' then iptm end) one_iptm, max(case when m='two' then iptm end) two_iptm, case when count(distinct m)=1 then max(iptm) end iptm from {_LONG} group by seq_id")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "scores").withColumn("iptm", F.round("iptm", 6))
    long = rows.select("seq_id", F.when(F.col("in_binding_site"), "one").otherwise("two").alias("method"), "iptm").unionByName(rows.where("iptm > 0.3 and in_binding_site").select("seq_id", F.lit("two").alias("method"), "iptm"))
    return overlap.aliased(long, ["one", "two"], ["iptm"])


@spec("j18b_assembled", f"select coalesce(p.seq_id,o.seq_id) seq_id, round(mean,6) mean, objective from (select * from {{predictions}} where mean > 24) p full outer join (select * from {OBJECTIVES} where objective > 0) o on p.seq_id=o.seq_id")
def j18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap.assembled([fixture(spark, sf_dir, "predictions").where("mean > 24").select("seq_id", "mean"), _objectives(spark, sf_dir).where("objective > 0")]), "mean")


@spec("j20_training_rows", f"select v.seq_id, label, objective from {{vectors}} v join {OBJECTIVES} o on v.seq_id=o.seq_id")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "vectors").join(_objectives(spark, sf_dir), "seq_id").select("seq_id", "label", "objective")
