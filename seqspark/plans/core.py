"""Queries of properties, filters, objectives, acquisition, ranking and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions import exprs, properties
from seqspark.operators import acquire, filters, select
from seqspark.plans.fixtures import fixture

SPECS: dict[str, tuple] = {}


def spec(name: str, sql: str | None = None):
    """Registers a query under ``name`` with its SQL in the notation of the fixtures."""

    def keep(f):
        SPECS[name] = (f, sql)
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Engines add in different orders, so doubles are compared to six places."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Properties. Both engines take distinct tiles, so that each sequence is one row.
PEPTIDES = "(select distinct sequence from {peptides})"


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "peptides").select("sequence").distinct()


def _count(letters: str) -> str:
    return f"(length(sequence)-length(regexp_replace(sequence,'[{letters}]','','g')))"


def _weighted(table: dict[str, float]) -> str:
    return "(" + "+".join(f"(length(sequence)-length(replace(sequence,'{a}','')))*({v}::double)" for a, v in table.items()) + ")"


def _share(letters: str) -> str:
    return f"round({_count(letters)}::double/length(sequence),6)"


MOMENT_SQL = f"""select p.sequence, round(case when sum(abs(h)) > 0 then sqrt(sum(h*cos(a))*sum(h*cos(a))+sum(h*sin(a))*sum(h*sin(a)))/sum(abs(h)) else 0 end, 6) hydrophobic_moment
    from (select sequence, i*100*pi()/180 a, coalesce(k.h,0) h from (select sequence, unnest(generate_series(0,length(sequence)-1)) i from {PEPTIDES}) s
    left join (values {",".join(f"('{a}',{h}::double)" for a, h in properties.HYDROPATHY.items())}) k(aa,h) on k.aa=substr(sequence,cast(i+1 as int),1)) p group by p.sequence"""

PROPERTIES = {
    "p01_length": ("length", properties.length, "length(sequence)"),
    "p02_molecular_weight": ("molecular_weight", properties.molecular_weight, f"round({_weighted(properties.MASS)}-(length(sequence)-1)*{properties.WATER},6)"),
    "p03_aromaticity": ("aromaticity", lambda s: properties.fraction(s, properties.AROMATIC), _share(properties.AROMATIC)),
    "p06_gravy": ("gravy", properties.gravy, f"round({_weighted(properties.HYDROPATHY)}/length(sequence),6)"),
    "p07_helix_fraction": ("helix_fraction", lambda s: properties.fraction(s, properties.HELIX), _share(properties.HELIX)),
    "p08_turn_fraction": ("turn_fraction", lambda s: properties.fraction(s, properties.TURN), _share(properties.TURN)),
    "p09_sheet_fraction": ("sheet_fraction", lambda s: properties.fraction(s, properties.SHEET), _share(properties.SHEET)),
    "p10_hydrophobic_fraction": ("hydrophobic_fraction", lambda s: properties.fraction(s, properties.HYDROPHOBIC), _share(properties.HYDROPHOBIC)),
    "p11_polar_fraction": ("polar_fraction", lambda s: properties.fraction(s, properties.POLAR), _share(properties.POLAR)),
    "p12_positive_fraction": ("positive_fraction", lambda s: properties.fraction(s, properties.POSITIVE), _share(properties.POSITIVE)),
    "p13_negative_fraction": ("negative_fraction", lambda s: properties.fraction(s, properties.NEGATIVE), _share(properties.NEGATIVE)),
    "p14_net_charge_fraction": ("net_charge_fraction", properties.net_charge_fraction, f"round({_count(properties.POSITIVE)}::double/length(sequence)-{_count(properties.NEGATIVE)}::double/length(sequence),6)"),
}


def _property(column: str, function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = function(F.col("sequence"))
        return _peptides(spark, sf_dir).select("sequence", (value if column == "length" else F.round(value, 6)).alias(column))

    return run


for _name, (_column, _function, _sql) in PROPERTIES.items():
    SPECS[_name] = (_property(_column, _function), f"select sequence, {_sql} {_column} from {PEPTIDES}")

_PAIR_WEIGHTS = "(select pair, 100*{U:pair}-50 weight from (select distinct substr(sequence,1,2) pair from {peptides} union select distinct substr(sequence,2,2) from {peptides}) where length(pair)=2)"


_INSTABILITY = f"select sequence, round(10*coalesce(sum(weight),0)/length(sequence),6) instability from (select sequence, substr(sequence,cast(i as int),2) pair from (select sequence, unnest(generate_series(1,greatest(length(sequence)-1,1))) i from {PEPTIDES})) s left join {_PAIR_WEIGHTS} w using (pair) group by sequence"


@spec("p04_instability_index", _INSTABILITY)
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(properties.instability_index(_peptides(spark, sf_dir), _weights(fixture(spark, sf_dir, "peptides"))), "instability")


def _weights(rows: DataFrame) -> DataFrame:
    pairs = rows.select(F.explode(F.array(F.substring("sequence", 1, 2), F.substring("sequence", 2, 2))).alias("pair")).distinct()
    return pairs.select("pair", (100 * exprs.uniform(42, "pair") - 50).alias("weight"))


def _charge_sql(ph: str) -> str:
    case = lambda pk, at, usual: f"case {at} " + " ".join(f"when '{a}' then {v}::double" for a, v in pk.items()) + f" else {usual}::double end"
    plus = [f"1/(1+pow(10.0::double,{ph}-({case(properties.PK_N_TERMINI, 'substr(sequence,1,1)', properties.PK_N_TERMINUS)})))"]
    plus += [f"(length(sequence)-length(replace(sequence,'{a}','')))/(1+pow(10.0::double,{ph}-{pk}::double))" for a, pk in properties.PK_POSITIVE.items()]
    minus = [f"1/(1+pow(10.0::double,({case(properties.PK_C_TERMINI, 'substr(sequence,-1,1)', properties.PK_C_TERMINUS)})-{ph}))"]
    minus += [f"(length(sequence)-length(replace(sequence,'{a}','')))/(1+pow(10.0::double,{pk}::double-{ph}))" for a, pk in properties.PK_NEGATIVE.items()]
    return f"({'+'.join(plus)}-({'+'.join(minus)}))"


_BISECT = f"""with recursive b as (select sequence, {properties.PH_RANGE[0]}::double lo, {properties.PH_RANGE[1]}::double hi, 0 step from {PEPTIDES}
    union all select sequence, case when {_charge_sql("(lo+hi)/2")} > 0 then (lo+hi)/2 else lo end, case when {_charge_sql("(lo+hi)/2")} > 0 then hi else (lo+hi)/2 end, step+1 from b where step < {properties.PH_STEPS})
    select sequence, round((lo+hi)/2, 5) isoelectric_point from b where step = {properties.PH_STEPS}"""


@spec("p05_isoelectric_point", _BISECT)
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.with_isoelectric_point(_peptides(spark, sf_dir), F.col("sequence")).withColumn("isoelectric_point", F.round("isoelectric_point", 5))


@spec("p15_hydrophobic_moment", MOMENT_SQL)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peptides(spark, sf_dir).select("sequence", F.round(properties.hydrophobic_moment(F.col("sequence")), 6).alias("hydrophobic_moment"))


_WIDE = ", ".join(f"{sql} {column}" for column, _, sql in PROPERTIES.values())


@spec("p16_all_properties", f"select p.*, isoelectric_point, hydrophobic_moment, instability from (select sequence, {_WIDE} from {PEPTIDES}) p join ({_BISECT}) b using (sequence) join ({MOMENT_SQL}) m using (sequence) join ({_INSTABILITY}) n using (sequence)")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Weights are of pairs alone, so tiles need not be distinct for them.
    wide = properties.with_all_properties(_peptides(spark, sf_dir), "sequence", properties.pair_weights(_weights(fixture(spark, sf_dir, "peptides"))))
    return rounded(wide, *(c for c in wide.columns if c not in ("sequence", "length", "isoelectric_point"))).withColumn("isoelectric_point", F.round("isoelectric_point", 5))


# Filters and checks.
_LONG_RUN = "|".join(a * 6 for a in exprs.ALPHABET)
_MOST = "greatest(" + ",".join(f"length(sequence)-length(replace(sequence,'{a}',''))" for a in exprs.ALPHABET) + ")"


@spec("f01_quality_filter", f"select sequence from {PEPTIDES} where length(sequence) > 5 and length(sequence) < 30 and {_MOST}::double/length(sequence) <= 0.75 and not regexp_matches(sequence,'{_LONG_RUN}')")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.quality_filter(_peptides(spark, sf_dir))


@spec("f02_alphabet", "select event_type word, regexp_matches(upper(event_type),'^[ACDEFGHIKLMNPQRSTVWY]+$') valid, count(*) n from {events} group by 1, 2")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("word"), F.upper("event_type").alias("sequence"))
    good, bad = filters.split_by_alphabet(rows)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).groupBy("word", "valid").agg(F.count("*").alias("n"))


@spec("f07_not_evaluated", "select p.seq_id, round(mean,6) mean, round(std,6) std from {predictions} p where not exists (select 1 from {scores} s where s.seq_id=p.seq_id and in_binding_site)")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fixture(spark, sf_dir, "scores").where("in_binding_site")
    return rounded(filters.not_evaluated(fixture(spark, sf_dir, "predictions"), done, "seq_id"), "mean", "std")


@spec("f11_same_length", "select count(*) n, count(distinct len(embedding)) lengths, count(distinct len(embedding)) <= 1 consistent from {vectors}")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.same_length(fixture(spark, sf_dir, "vectors"))


@spec("f12_consistent_objectives", "select count(*) n, count(distinct names) kinds, count(distinct names) <= 1 consistent from (select seq_id, string_agg(obj, ',' order by obj) names from {predictions_multi} group by seq_id)")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.consistent_objectives(fixture(spark, sf_dir, "predictions_multi"))


# Objectives.
def _clip(c: str) -> str:
    lo, hi = acquire.V1_RANGES[c]
    return f"greatest(0.0::double,least(1.0::double,({c}-({lo}::double))/(({hi}::double)-({lo}::double))))"


_V1 = f"case when in_binding_site then (-{_clip('rosetta_score')}-({_clip('distance_score')}+{acquire.V1_DISTANCE}::double)*({_clip('interface_dg')}-{acquire.V1_ENERGY}::double))*(-{_clip('iptm')}*({_clip('sequence_pae')}-{acquire.V1_PAE}::double)) else -1.0::double end"


@spec("o01_objective_v1", f"select seq_id, round({_V1},6) objective from {{scores}}")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "scores").select("seq_id", F.round(acquire.objective_v1(), 6).alias("objective"))


_V0 = {"interface_dg": 0.4, "rosetta_score": 0.3, "iptm": 0.3}


@spec(
    "o02_objective_v0",
    "select seq_id, round(case when in_binding_site then 0.4*(0.1+0.9*(-interface_dg-a0)/(a1-a0))+0.3*(0.1+0.9*(-rosetta_score-b0)/(b1-b0))+0.3*(0.1+0.9*(iptm-c0)/(c1-c0)) else 0 end,6) objective"
    " from {scores}, (select min(-interface_dg) a0, max(-interface_dg) a1, min(-rosetta_score) b0, max(-rosetta_score) b1, min(iptm) c0, max(iptm) c1 from {scores})",
)
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.objective_v0(fixture(spark, sf_dir, "scores"), _V0, ["interface_dg", "rosetta_score"]), "objective")


@spec("o03_multi_objective", "select seq_id, 'interface_dg' obj, round(interface_dg,6) as value from {scores} union all select seq_id, 'iptm', round(iptm,6) from {scores}")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.scores_long(fixture(spark, sf_dir, "scores"), ["interface_dg", "iptm"]), "value")


@spec("o04_user_objective", "select seq_id, round(2*iptm,6) objective from {scores}")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.create_objective(fixture(spark, sf_dir, "scores"), lambda s, factor: factor * F.col("iptm"), factor=2), "objective")


@spec("o05_iptm_minus_pae", "select seq_id, round(iptm-sequence_pae/30,6) objective from {scores}")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.create_objective(fixture(spark, sf_dir, "scores"), acquire.iptm_minus_pae), "objective")


# Acquisition.
def _cdf(z: str) -> str:
    x = f"abs({z})"

    def polynomial(c: tuple[float, ...]) -> str:
        out = f"{c[0]}::double"
        for a in c[1:]:
            out = f"({out}*{x}+{a}::double)"
        return out

    tail = f"({x}+1/({x}+2/({x}+3/({x}+4/({x}+0.65::double)))))"
    upper = f"(case when {x} < 7.07106781186547 then exp(-{x}*{x}/2)*{polynomial(exprs.HART_P)}/{polynomial(exprs.HART_Q)} else exp(-{x}*{x}/2)/({tail}*2.506628274631::double) end)"
    return f"(case when {z} > 0 then 1-{upper} else {upper} end)"


_EI = "select seq_id, round(case when std > 1e-12 then (mean-20)*{c}+std*exp(-z*z/2)/sqrt(2*pi()) else 0 end,6) acquisition from (select *, (mean-20)/nullif(std,0) z from {{predictions}})".format(c=_cdf("z"))


@spec("a01_expected_improvement", _EI)
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.acquisition(fixture(spark, sf_dir, "predictions"), "expected_improvement", best=20.0).select("seq_id", "acquisition"), "acquisition")


@spec("a02_confidence_bound", "select seq_id, round(mean+1.96*std,6) upper_bound, round(mean-1.96*std,6) lower_bound from {predictions}")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "predictions").select("seq_id", F.round(acquire.confidence_bound(), 6).alias("upper_bound"), F.round(acquire.confidence_bound(maximise=False), 6).alias("lower_bound"))


@spec("a03_probability_of_improvement", "select seq_id, round(case when std > 1e-12 then {c} else 0 end,6) acquisition from (select *, (mean-20)/nullif(std,0) z from {{predictions}})".format(c=_cdf("z")))
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.acquisition(fixture(spark, sf_dir, "predictions"), "probability_of_improvement", best=20.0).select("seq_id", "acquisition"), "acquisition")


@spec("a04_standard_deviation", "select seq_id, round(std,6) acquisition from {predictions}")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.acquisition(fixture(spark, sf_dir, "predictions"), "standard_deviation").select("seq_id", "acquisition"), "acquisition")


@spec("a05_mean", "select seq_id, round(mean,6) acquisition from {predictions}")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.acquisition(fixture(spark, sf_dir, "predictions"), "mean").select("seq_id", "acquisition"), "acquisition")


_WAYS = {"obj1": "max", "obj2": "min"}
_WEIGHTS = {"obj1": 0.6, "obj2": 0.4}
_POINTS = "(select min(case when obj='obj1' then -mean end) i1, max(case when obj='obj1' then -mean end) n1, min(case when obj='obj2' then mean end) i2, max(case when obj='obj2' then mean end) n2 from {predictions_multi})"
_BOTH = "(select a.seq_id, -a.mean m1, a.std s1, b.mean m2, b.std s2 from {predictions_multi} a join {predictions_multi} b on a.seq_id=b.seq_id where a.obj='obj1' and b.obj='obj2')"


@spec("a07_parego_ucb", f"select seq_id, round(-(greatest(0.6*u,0.4*v)+0.05*(0.6*u+0.4*v)),6) acquisition from (select seq_id, (m1-s1-i1)/(n1-i1) u, (m2-s2-i2)/(n2-i2) v from {_BOTH}, {_POINTS})")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    multi = fixture(spark, sf_dir, "predictions_multi")
    return rounded(acquire.acquisition(multi, "parego_chebyshev_ucb", directions=_WAYS, weights=_WEIGHTS), "acquisition")


_DRAW = "sqrt(-2*ln({{U:seq_id,'{o}',j,'a'}}))*cos(2*pi()*{{U:seq_id,'{o}',j,'b'}})"


@spec(
    "a06_parego_ei",
    f"with m as (select seq_id, m1, s1, m2, s2, i1, n1, i2, n2, greatest(0.6*(m1-i1)/(n1-i1),0.4*(m2-i2)/(n2-i2))+0.05*(0.6*(m1-i1)/(n1-i1)+0.4*(m2-i2)/(n2-i2)) g from {_BOTH}, {_POINTS}), b as (select min(g) best from m),"
    f" d as (select seq_id, 0.6*(m1+s1*{_DRAW.format(o='obj1')}-i1)/(n1-i1) u, 0.4*(m2+s2*{_DRAW.format(o='obj2')}-i2)/(n2-i2) v, best from m, b, (select unnest(generate_series(1,64)) j))"
    " select seq_id, round(avg(greatest(0,best-(greatest(u,v)+0.05*(u+v)))),6) acquisition from d group by seq_id",
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    multi = fixture(spark, sf_dir, "predictions_multi")
    return rounded(acquire.acquisition(multi, "parego_chebyshev_ei", directions=_WAYS, weights=_WEIGHTS, draws=64), "acquisition")


@spec("g07_reference_points", "select obj, round(min(case when obj='obj1' then -mean else mean end),6) ideal, round(max(case when obj='obj1' then -mean else mean end),6) nadir from {predictions_multi} group by obj")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.reference_points(fixture(spark, sf_dir, "predictions_multi"), _WAYS), "ideal", "nadir")


# Ranking and selection.
def _objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "scores").select("seq_id", F.round(acquire.objective_v1(), 6).alias("objective"))


OBJECTIVES = f"(select seq_id, round({_V1},6) objective from {{scores}})"


@spec("w01_leaderboard", f"select row_number() over (order by objective desc, seq_id)::int as rank, seq_id, objective from {OBJECTIVES} order by objective desc, seq_id limit 20")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.leaderboard(_objectives(spark, sf_dir), 20, key="seq_id")


@spec("w02_leaderboard_by_objective", "select * from (select (row_number() over (partition by obj order by case when obj='obj2' then mean else -mean end, seq_id))::int as rank, obj, seq_id, round(mean,6) as value from {predictions_multi}) where rank <= 10")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.leaderboard_by_objective(fixture(spark, sf_dir, "predictions_multi").withColumnRenamed("mean", "value"), 10, {"obj1": "max", "obj2": "min"}), "value")


@spec("w03_top_by_acquisition", f"select * from ({_EI}) order by acquisition desc, seq_id limit 50")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_by(a01(spark, sf_dir), "acquisition", 50)


@spec("w04_parents", f"select seq_id, objective from (select * from {OBJECTIVES} order by objective desc, seq_id limit (select greatest(10, cast(floor(count(*)*0.2) as bigint)) from {OBJECTIVES})) order by {{U:seq_id}}, seq_id limit 10")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.parents(_objectives(spark, sf_dir), 10, 0.2)


@spec("w05_parents_by_objective", "select seq_id from (select distinct seq_id from (select seq_id, row_number() over (partition by obj order by case when obj='obj2' then mean else -mean end, seq_id) r from {predictions_multi}) where r <= 50) order by {U:seq_id}, seq_id limit 10")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.parents_by_objective(fixture(spark, sf_dir, "predictions_multi").withColumnRenamed("mean", "value"), 10, 50, {"obj1": "max", "obj2": "min"})


@spec("w06_exponential_parents", f"select seq_id, objective from {OBJECTIVES}, (select min(objective) lo, max(objective) hi from {OBJECTIVES}) order by -ln({{U:seq_id}})/exp(2*case when hi > lo then (objective-lo)/(hi-lo) else 0.5 end), seq_id limit 10")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exponential_parents(_objectives(spark, sf_dir), 10, beta=2.0)


_FITNESS = "(select seq_id, avg(case when hi > lo then case when o.obj='obj2' then 1-(mean-lo)/(hi-lo) else (mean-lo)/(hi-lo) end else 0.5 end) fitness from {predictions_multi} o join (select obj, min(mean) lo, max(mean) hi from {predictions_multi} group by obj) b on o.obj=b.obj group by seq_id)"


@spec("w06b_exponential_parents_multi", f"select seq_id, round(fitness,6) fitness from {_FITNESS} order by -ln({{U:seq_id}})/exp(2*fitness), seq_id limit 10")
def w06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.exponential_parents_multi(fixture(spark, sf_dir, "predictions_multi").withColumnRenamed("mean", "value"), 10, {"obj1": "max", "obj2": "min"}, beta=2.0), "fitness")


@spec("w07_adalead", f"select seq_id, objective from {OBJECTIVES} where objective >= (1-0.5)*(select max(objective) from {OBJECTIVES})")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.adalead(_objectives(spark, sf_dir), 0.5)


@spec("w08_latest_batch", "select event_id, sequence, iteration, objective from {score_log} where iteration = (select max(iteration) from {score_log})")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.latest_batch(fixture(spark, sf_dir, "score_log")).select("event_id", "sequence", "iteration", "objective")


@spec("w11_random_rows", "select seq_id from {predictions} order by {U:seq_id}, seq_id limit 25")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.random_rows(fixture(spark, sf_dir, "predictions"), 25).select("seq_id")


def _greedy_sql(k: int) -> str:
    value = "(1.0::double+label)"
    base = f"v as (select seq_id, {value} a, embedding::double[] e from {{vectors}})"
    parts = [base, "s1 as (select seq_id, e from v order by a desc, seq_id limit 1)", "n1 as (select v.seq_id, v.a, v.e, list_distance(v.e, s1.e) m from v, s1)"]
    for i in range(2, k + 1):
        parts.append(f"s{i} as (select seq_id, e from n{i - 1} where seq_id not in ({' union '.join(f'select seq_id from s{j}' for j in range(1, i))}) order by a*m desc, seq_id limit 1)")
        parts.append(f"n{i} as (select n.seq_id, n.a, n.e, least(n.m, list_distance(n.e, s{i}.e)) m from n{i - 1} n, s{i})")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select {i} as rank, seq_id from s{i}" for i in range(1, k + 1))


@spec("w12_greedy_batch", _greedy_sql(5))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").select("seq_id", (1.0 + F.col("label")).alias("acquisition"), "embedding")
    return select.greedy_batch(rows, 5)


@spec("w13_token_order", "select structure_id, chain, res_idx, token_idx from {residues}")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "residues")


# Set operations.
@spec("u01_newly_logged", f"select seq_id, objective from {OBJECTIVES} where seq_id not in (select seq_id from {{scores}} where in_binding_site)")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.newly_logged(_objectives(spark, sf_dir), fixture(spark, sf_dir, "scores").where("in_binding_site"))


@spec("u02_upsert", f"select seq_id, objective from {OBJECTIVES} where seq_id not in (select seq_id from {{scores}} where iptm > 0.5) union all select seq_id, round(iptm,6) from {{scores}} where iptm > 0.5")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = fixture(spark, sf_dir, "scores").where("iptm > 0.5").select("seq_id", F.round("iptm", 6).alias("objective"))
    return select.upsert(_objectives(spark, sf_dir), new)


@spec("u03_union_candidates", "select sequence, max(origin) origin from (select sequence, 'local' origin from {peptides} where start_pos < 100 union all select sequence, 'global' from {peptides} where start_pos >= 100) group by sequence")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "peptides")
    return select.union_candidates(rows.where("start_pos < 100").select("sequence"), rows.where("start_pos >= 100").select("sequence"))


@spec("u04_common_keys", f"select p.seq_id, round(mean,6) mean, objective from {{predictions}} p join {OBJECTIVES} o on p.seq_id=o.seq_id")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.common_keys(fixture(spark, sf_dir, "predictions"), _objectives(spark, sf_dir)).select("seq_id", "mean", "objective"), "mean")


@spec("u05_with_roles", "select seq_id, 'scored' as role from {scores} where in_binding_site union all select seq_id, 'candidate' from {predictions}")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_roles(fixture(spark, sf_dir, "scores").where("in_binding_site").select("seq_id"), fixture(spark, sf_dir, "predictions").select("seq_id"))


@spec("s13_latest_rows", "select sequence, round(objective,6) objective, iteration from (select *, row_number() over (partition by sequence order by iteration desc, event_id desc) r from {score_log}) where r = 1")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.latest_rows(fixture(spark, sf_dir, "score_log"), "sequence", ["iteration", "event_id"]).select("sequence", "objective", "iteration"), "objective")
