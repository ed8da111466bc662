"""Queries of structures, confidence, metrics, embeddings, generation and surrogates, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.exprs import uniform
from seqspark.operators import acquire, confidence, contacts, embed, filters, generate, metrics, secondary, select, surrogate
from seqspark.plans.core import rounded
from seqspark.plans.fixtures import fixture

SPECS: dict[str, tuple] = {}


def spec(name: str, sql: str | None = None):
    def keep(f):
        SPECS[name] = (f, sql)
        return f

    return keep


CUTOFF = 6.0
_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_PAIRS = f"(select a.structure_id, a.res_idx ra, b.res_idx rb, {_D} d from {{atoms}} a join {{atoms}} b on a.structure_id=b.structure_id where a.chain='A' and b.chain='B' and {_D} <= {CUTOFF})"


@spec("j01_distance_score", f"select s.structure_id, coalesce(n,0) n_receptor, round(case when na=0 or nb=0 then 0 else coalesce(m,'infinity'::double) end,6) distance_score from (select structure_id, sum((chain='A')::int) na, sum((chain='B')::int) nb from {{atoms}} group by 1) s left join (select structure_id, count(*) n, avg(d) m from (select structure_id, ra, min(d) d from {_PAIRS} group by 1,2) group by 1) t on s.structure_id=t.structure_id")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contacts.distance_score(fixture(spark, sf_dir, "atoms"), cutoff=CUTOFF), "distance_score")


@spec("j02_binding_sites", f"select structure_id, string_agg(distinct ra::varchar, ',' order by ra::varchar) receptor_site, string_agg(distinct rb::varchar, ',' order by rb::varchar) sequence_site from {_PAIRS} group by structure_id")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias(c)
    return contacts.binding_sites(fixture(spark, sf_dir, "atoms"), cutoff=CUTOFF).select("structure_id", joined("receptor_site"), joined("sequence_site"))


@spec("j03_n_contacts", f"select structure_id, count(distinct ra) n_contacts from {_PAIRS} group by structure_id")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.binding_sites(fixture(spark, sf_dir, "atoms"), cutoff=CUTOFF).select("structure_id", F.size("receptor_site").cast("long").alias("n_contacts"))


@spec("j04_in_site", f"select s.structure_id, coalesce(n,0) n_in_site, coalesce(n,0)>=3 in_site from (select distinct structure_id from {{atoms}}) s left join (select structure_id, count(distinct ra) n from {_PAIRS} p where exists (select 1 from {{site}} b where b.structure_id=p.structure_id and b.res_idx=p.ra) group by 1) t on s.structure_id=t.structure_id")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.in_site(fixture(spark, sf_dir, "atoms"), fixture(spark, sf_dir, "site"), 3, cutoff=CUTOFF)


@spec("j06_centroid_proximity", "select structure_id, round(d,6) centroid_distance, d <= 5 near from (select a.structure_id, sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz)) d from (select structure_id, avg(x) ax, avg(y) ay, avg(z) az from {atoms} a where chain='A' and exists (select 1 from {site} s where s.structure_id=a.structure_id and s.res_idx=a.res_idx) group by 1) a join (select structure_id, avg(x) bx, avg(y) by_, avg(z) bz from {atoms} where chain='B' group by 1) b on a.structure_id=b.structure_id)")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contacts.centroid_proximity(fixture(spark, sf_dir, "atoms"), fixture(spark, sf_dir, "site"), 5.0), "centroid_distance")


@spec("j07_smooth_site_score", f"select structure_id, round(avg(1/(1+exp(d-5))),6) smooth_score from (select a.structure_id, a.res_idx, min({_D}) d from {{atoms}} a join {{atoms}} b on a.structure_id=b.structure_id where a.chain='A' and b.chain='B' and a.res_idx%2=0 group by 1,2) group by 1")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contacts.smooth_site_score(fixture(spark, sf_dir, "atoms"), fixture(spark, sf_dir, "site")), "smooth_score")


@spec("j08_weighted_plddt", f"select r.structure_id, round(avg(case when h.rb is not null then plddt else 0 end),6) weighted_plddt from {{residues}} r join {{plddt}} p on r.structure_id=p.structure_id and r.token_idx=p.token_idx left join (select distinct structure_id, rb from {_PAIRS}) h on h.structure_id=r.structure_id and h.rb=r.res_idx where r.chain='B' group by 1")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contacts.weighted_plddt(fixture(spark, sf_dir, "plddt"), fixture(spark, sf_dir, "residues"), fixture(spark, sf_dir, "atoms"), cutoff=CUTOFF), "weighted_plddt")


@spec("j09_sequence_plddt", "select r.structure_id, round(avg(plddt),6) sequence_plddt from {residues} r join {plddt} p on r.structure_id=p.structure_id and r.token_idx=p.token_idx where chain='B' group by 1")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confidence.chain_plddt(fixture(spark, sf_dir, "plddt"), fixture(spark, sf_dir, "residues"), "b"), "sequence_plddt")


@spec("j10_sequence_pae", "select p.structure_id, round(avg(pae),6) sequence_error from {pae} p join {residues} r on r.structure_id=p.structure_id and r.token_idx=p.i where chain='B' group by 1")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confidence.chain_error(fixture(spark, sf_dir, "pae"), fixture(spark, sf_dir, "residues")), "sequence_error")


@spec("j11_sequence_pde", "select p.structure_id, round(avg(pae/2),6) sequence_error from {pae} p join {residues} r on r.structure_id=p.structure_id and r.token_idx=p.i where chain='B' group by 1")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pde = fixture(spark, sf_dir, "pae").withColumn("pde", F.col("pae") / 2)
    return rounded(confidence.chain_error(pde, fixture(spark, sf_dir, "residues"), value="pde"), "sequence_error")


_IPSAE = "select structure_id, c1 chain_1, c2 chain_2, s score, i token_idx from (select *, row_number() over (partition by structure_id, c1, c2 order by s desc, i) r from (select structure_id, c1, c2, i, avg(1/(1+pow(pae/(1.24*pow(greatest(n,27)-15,1.0::double/3)-1.8),2))) s from (select p.structure_id, i, j, pae, a.chain c1, b.chain c2, count(*) over (partition by p.structure_id, i, b.chain) n from {pae} p join {residues} a on a.structure_id=p.structure_id and a.token_idx=i join {residues} b on b.structure_id=p.structure_id and b.token_idx=j where pae < 10 and a.chain<>b.chain) group by 1,2,3,4)) where r=1"


@spec("j12_chain_pair_scores", f"select structure_id, chain_1, chain_2, round(score,6) score, token_idx from ({_IPSAE})")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confidence.chain_pair_scores(fixture(spark, sf_dir, "pae"), fixture(spark, sf_dir, "residues")), "score")


@spec("j13_chain_pair_bounds", f"select structure_id, least(chain_1,chain_2) chain_a, greatest(chain_1,chain_2) chain_b, round(max(score),6) largest, round(min(score),6) least, case when coalesce(max(case when chain_1<chain_2 then score end),-1) >= coalesce(max(case when chain_1>chain_2 then score end),-1) then 'forward' else 'backward' end direction from ({_IPSAE}) group by 1,2,3")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = confidence.chain_pair_scores(fixture(spark, sf_dir, "pae"), fixture(spark, sf_dir, "residues"))
    return rounded(confidence.chain_pair_bounds(scores), "largest", "least")


@spec("g01_monomer_confidence", "select p.structure_id, round(mp,6) mean_plddt, round({U:p.structure_id,'ptm'},6) ptm, round(me,6) mean_pae from (select structure_id, avg(plddt) mp from {plddt} group by 1) p join (select structure_id, avg(pae) me from {pae} group by 1) e on p.structure_id=e.structure_id")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fixture(spark, sf_dir, "plddt").groupBy("structure_id").agg(F.collect_list("plddt").alias("plddt"))
    rows = fixture(spark, sf_dir, "pae").groupBy("structure_id", "i").agg(F.collect_list("pae").alias("row")).groupBy("structure_id").agg(F.collect_list("row").alias("pae"))
    whole = vectors.join(rows, "structure_id").withColumn("ptm", uniform(42, "structure_id", F.lit("ptm")))
    return rounded(confidence.monomer_confidence(whole), "mean_plddt", "ptm", "mean_pae")


@spec("f04_structure_subset", "select structure_id, chain, res_idx, round(x,6) x from {atoms} where chain in ('A') and res_idx between 3 and 20")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = fixture(spark, sf_dir, "atoms").withColumn("res_seq", F.col("res_idx"))
    return rounded(filters.structure_subset(atoms, ["A"], residues=(3, 20)).select("structure_id", "chain", "res_idx", "x"), "x")


@spec("t06_chains", "select structure_id, string_agg(distinct chain, ',' order by chain) chains from {atoms} group by 1")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "atoms").groupBy("structure_id").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"))


# Metrics over predictions; the truth is a deterministic function of the key.
_ROWS = "(select seq_id, obj, mean, std, mean+2*std*({U:seq_id,obj}-0.5) y from {predictions_multi})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqspark.functions.exprs import uniform

    return fixture(spark, sf_dir, "predictions_multi").withColumn("y", F.col("mean") + 2 * F.col("std") * (uniform(42, "seq_id", "obj") - 0.5))


_FIT = f"select obj, avg((y-mean)*(y-mean)) mse, avg(abs(y-mean)) mae, 1-sum((y-mean)*(y-mean))/sum((y-c)*(y-c)) r2 from {_ROWS} join (select obj, avg(y) c from {_ROWS} group by 1) using (obj) group by 1"


@spec("g02_fit_metrics", f"with m as ({_FIT}) select obj, round(mse,6) mse, round(mae,6) mae, round(r2,6) r2 from m union all select null, round(avg(mse),6), round(avg(mae),6), round(avg(r2),6) from m")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fit_metrics(_rows(spark, sf_dir)), "mse", "mae", "r2")


@spec("g03_gaussian_nll", f"select obj, round(avg(0.5*(pow((y-mean)/greatest(std,1e-6),2)+2*ln(greatest(std,1e-6))+ln(2*pi()))),6) nll from {_ROWS} group by 1")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).groupBy("obj").agg(metrics.gaussian_nll(F.col("y"), F.col("mean"), F.col("std")).alias("nll")), "nll")


@spec("g04_multi_nll", f"select round(avg(v),6) nll from (select seq_id, avg(0.5*(pow((y-mean)/greatest(std,1e-6),2)+2*ln(greatest(std,1e-6))+ln(2*pi()))) v from {_ROWS} group by 1)")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.multi_nll(_rows(spark, sf_dir)), "nll")


@spec("g05_evidential_loss", f"select obj, round(avg(0.5*ln(pi()/2)-3*ln(2*std*3)+3.5*ln(pow(y-mean,2)*2+2*std*3)+lgamma(3)-lgamma(3.5)+0.1*abs(y-mean)*7),6) loss from {_ROWS} group by 1")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = metrics.evidential_loss(F.col("y"), F.col("mean"), F.lit(2.0), F.lit(3.0), F.col("std"))
    return rounded(_rows(spark, sf_dir).groupBy("obj").agg(loss.alias("loss")), "loss")


@spec("g06_mean_variance_loss", f"select obj, round(avg(0.5*(lv+pow(y-mean,2)*exp(-lv)))+0.01*avg(-lv),6) loss from (select *, greatest(-10,least(10,2*ln(std))) lv from {_ROWS}) group by 1")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rows(spark, sf_dir).groupBy("obj").agg(metrics.mean_variance_loss(F.col("y"), F.col("mean"), 2 * F.ln("std")).alias("loss")), "loss")


@spec("g11_calibration", f"select round(avg(case when abs(y-mean)/std <= 2 then 1 else 0 end),6) within_two, round(sqrt(avg(pow(y-mean,2))),6) rmse from {_ROWS}")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration(_rows(spark, sf_dir)), "within_two", "rmse")


@spec("g08_scaler", "select dim, round(avg(v),6) mean, round(case when stddev_pop(v)=0 then 1 else stddev_pop(v) end,6) std from (select unnest(embedding)::double v, (unnest(generate_series(0,len(embedding)-1)))::int dim from {vectors}) group by dim")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(embed.scaler(rows), "mean", "std")


@spec("g10_search_space", "select count(*) n_candidates, count(s.seq_id) n_evaluated, count(*)-count(s.seq_id) n_remaining, max(len(embedding)) input_dim from {vectors} v left join (select distinct seq_id from {scores}) s on v.seq_id=s.seq_id")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.search_space(fixture(spark, sf_dir, "vectors"), fixture(spark, sf_dir, "scores"))


PROPERTY_TABLE = {"charge": {"K": 1.0, "R": 1.0, "H": 0.5, "D": -1.0, "E": -1.0}, "size": {"G": 0.1, "A": 0.2, "W": 1.0, "F": 0.8, "Y": 0.9}}
_SUM = {n: "(" + "+".join(f"(length(sequence)-length(replace(sequence,'{a}','')))*({v}::double)" for a, v in t.items()) + ")/length(sequence)" for n, t in PROPERTY_TABLE.items()}


@spec("e01_average_embedding", f"select sequence, round({_SUM['charge']},6) charge, round({_SUM['size']},6) size from (select distinct sequence from {{peptides}})")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.average_embedding(fixture(spark, sf_dir, "peptides").select("sequence").distinct(), PROPERTY_TABLE)
    return rows.select("sequence", F.round(F.col("embedding")[0], 6).alias("charge"), F.round(F.col("embedding")[1], 6).alias("size"))


@spec("e02_residue_embedding", "select aa, count(*) n, round(sum((case aa when 'K' then 1 when 'R' then 1 when 'H' then 0.5 when 'D' then -1 when 'E' then -1 else 0 end)::double),6) charge from (select substr(sequence, cast(i as int), 1) aa from (select sequence, unnest(generate_series(1,length(sequence))) i from (select distinct sequence from {peptides}))) group by aa")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.residue_embedding(fixture(spark, sf_dir, "peptides").select("sequence").distinct(), PROPERTY_TABLE)
    rows = rows.withColumn("aa", F.substr("sequence", F.col("pos") + 1, F.lit(1)))
    return rows.groupBy("aa").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0]), 6).alias("charge"))


@spec("g09_pooled", f"select sequence, round({_SUM['charge']},6) charge from (select distinct sequence from {{peptides}})")
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.pooled(embed.residue_embedding(fixture(spark, sf_dir, "peptides").select("sequence").distinct(), PROPERTY_TABLE), size=len(PROPERTY_TABLE))
    return rows.select("sequence", F.round(F.col("embedding")[0], 6).alias("charge"))


@spec("e04_scaled", "with l as (select seq_id, unnest(embedding)::double v, unnest(generate_series(0,len(embedding)-1)) dim from {vectors}), s as (select dim, avg(v) m, case when stddev_pop(v)=0 then 1 else stddev_pop(v) end d from l group by 1) select seq_id, round(sum((v-m)/d),6) total from l join s using (dim) group by 1")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = embed.scaled(rows, embed.scaler(rows))
    return out.select("seq_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@spec("e05_components")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors")
    return embed.Components.fit(rows, n=3).transform(rows).select("seq_id", "embedding")


@spec("e06_components_by_ratio")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors")
    return embed.Components.fit(rows, ratio=0.5).transform(rows).select("seq_id", "embedding")


# Secondary structure.
def _secondary() -> str:
    """The same by self-joins of all residues of a chain, without cells."""
    d = lambda a, b: "sqrt(" + "+".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in "xyz") + ")"
    whole = "select structure_id, chain, res_seq, " + ", ".join(f"max(case when atom_name='{a}' then struct_pack(x := x, y := y, z := z) end) {a.lower()}" for a in ("N", "CA", "C", "O")) + " from {backbone} group by 1,2,3"
    rows = f"select *, row_number() over w - 1 k, count(*) over (partition by structure_id, chain) size, lag(c) over w b from ({whole}) where n is not null and ca is not null and c is not null and o is not null window w as (partition by structure_id, chain order by res_seq)"
    length = lambda v: "sqrt(" + "+".join(f"({x})*({x})" for x in v) + ")"
    u, v = [f"n.{c}-b.{c}" for c in "xyz"], [f"n.{c}-ca.{c}" for c in "xyz"]
    w = [f"(({a})/{length(u)}+({e})/{length(v)})" for a, e in zip(u, v, strict=True)]
    h = "struct_pack(" + ", ".join(f"{c} := n.{c}+1.01*{x}/{length(w)}" for c, x in zip("xyz", w, strict=True)) + ")"
    return f"""with r as materialized ({rows}), h as materialized (select *, case when k>0 then {h} end h from r),
        bonds as materialized (select a.structure_id, a.chain, a.k i, g.k j, a.size from h a join h g on a.structure_id=g.structure_id and a.chain=g.chain and a.k<a.size-1 and g.k>0 and not (g.k-a.k between 0 and 2)
            where 27.888*(1/{d("a.o", "g.n")}+1/{d("a.c", "g.h")}-1/{d("a.o", "g.h")}-1/{d("a.c", "g.n")}) < -0.5),
        t as (select r.structure_id, r.chain, r.k, """ + ", ".join(f"exists (select 1 from bonds b where b.structure_id=r.structure_id and b.chain=r.chain and b.i=r.k and b.j=r.k+{s}) t{s}" for s in (3, 4, 5)) + """ from r),
        g as (select *, """ + ", ".join(f"coalesce(t{s} and lag(t{s}) over (partition by structure_id, chain order by k), false) g{s}" for s in (3, 4, 5)) + """ from t),
        h4 as (select *, max(g4) over (partition by structure_id, chain order by k rows between 3 preceding and current row) helix4 from g),
        f as (select *, not helix4 and not coalesce(lead(helix4) over (partition by structure_id, chain order by k), false) free from h4),
        x as (select *, helix4 or max(g3 and free) over (partition by structure_id, chain order by k rows between 2 preceding and current row) or max(g5 and free) over (partition by structure_id, chain order by k rows between 4 preceding and current row) helix from f),
        pairs as (select p.structure_id, p.chain, p.size, case when q.i=p.j and q.j=p.i then p.i else p.i+1 end a, case when q.i=p.j-2 then p.j-1 else p.j end b
            from bonds p join bonds q on p.structure_id=q.structure_id and p.chain=q.chain and ((q.i=p.j and q.j=p.i) or (q.i=p.j-2 and q.j=p.i+2) or (q.i=p.j and q.j=p.i+2))),
        ladder as (select distinct structure_id, chain, unnest([a,b]) k from pairs where a between 1 and size-2 and b between 1 and size-2)
        select structure_id, chain, count(*) n_residues, round(avg(helix::int),6) helix_fraction, round(avg((not helix and l.k is not null)::int),6) sheet_fraction, round(avg((not helix and l.k is null)::int),6) loop_fraction
        from x left join ladder l using (structure_id, chain, k) group by 1, 2"""


@spec("t10_secondary_fractions", _secondary())
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(secondary.secondary_fractions(fixture(spark, sf_dir, "backbone")), "helix_fraction", "sheet_fraction", "loop_fraction")


# Generation.
@spec("c10_tiles", "select seq_id protein_id, count(*) n, count(distinct substr(sequence, cast(i+1 as int), 8)) kinds from (select seq_id, sequence, unnest(generate_series(0,length(sequence)-8)) i from {sequences} where length(sequence) >= 8) group by 1")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = fixture(spark, sf_dir, "sequences").withColumnRenamed("seq_id", "protein_id")
    return generate.tile_kinds(proteins, 8)


_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@spec("c01_random_letters", f"select id, string_agg(substr('{_LETTERS}', cast(1+floor({{U:id,i}}*20) as int), 1), '' order by i) as sequence from (select id, unnest(generate_series(1,size)) i from (select seq_id id, cast(7+floor({{U:seq_id,'length'}}*8) as int) size from {{vectors}})) group by id")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors").select(F.col("seq_id").alias("id")).withColumn("length", generate.uniform_int(42, 7, 14, "id", F.lit("length")))
    return generate.letters(rows)


@spec("c02_mutated")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "peptides").select("sequence").distinct().select(F.xxhash64("sequence").alias("id"), F.col("sequence").alias("parent"))
    return generate.mutated(rows)


@spec("c03_mutant_pool")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixture(spark, sf_dir, "peptides").select("sequence").distinct()
    return generate.mutant_pool(select.random_rows(known, 50, key="sequence"), 200, known)


@spec(
    "c06_sampled_peptides",
    "select id, protein_id, start_pos, substr(sequence, start_pos+1, size) as sequence from (select *, case when length(sequence)<=size then 0 else greatest(0, least(length(sequence)-size, middle-cast(floor(size/2) as int))) end::int start_pos"
    " from (select id, protein_id, sequence, greatest(7,least(14,trunc(10.5+(7.0/6)*sqrt(-2*ln({U:id,'length','a'}))*cos(2*pi()*{U:id,'length','b'}))))::int as size, cast(floor({U:id,'middle'}*length(sequence)) as int) middle"
    " from (select unnest(generate_series(0,999)) id) d join (select seq_id protein_id, sequence, row_number() over (order by seq_id)-1 place, count(*) over () n from {sequences} where length(sequence)>0) p on p.place=cast(floor({U:id,'protein'}*n) as bigint)))",
)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = fixture(spark, sf_dir, "sequences").withColumnRenamed("seq_id", "protein_id")
    return generate.sampled_peptides(proteins, 1000, 7, 14, gaussian=True)


@spec(
    "c08_local_peptides",
    "select id, protein_id, start_pos, substr(sequence, start_pos+1, size) as sequence from (select *, greatest(0, least(length(sequence)-size, cast(round(pos+3.0*sqrt(-2*ln({U:protein_id,pos,id,'p','a'}))*cos(2*pi()*{U:protein_id,pos,id,'p','b'})) as int)))::int start_pos"
    " from (select c.id, c.protein_id, c.pos, s.sequence, greatest(7,least(20,cast(round(n+2.0*sqrt(-2*ln({U:c.protein_id,c.pos,c.id,'l','a'}))*cos(2*pi()*{U:c.protein_id,c.pos,c.id,'l','b'})) as int))) as size"
    " from (select protein_id, start_pos pos, length(sequence) n, unnest([0,1]) id from {peptides}) c join {sequences} s on s.seq_id=c.protein_id))",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = fixture(spark, sf_dir, "sequences").withColumnRenamed("seq_id", "protein_id")
    return generate.local_peptides(fixture(spark, sf_dir, "peptides").select("protein_id", "start_pos", "sequence"), proteins, 2, 3.0, 2.0, 7, 20)


# Surrogates.
def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "vectors")
    return rows.select("seq_id", F.col("embedding").cast("array<double>").alias("embedding"), (3 * F.col("embedding")[0] - F.col("embedding")[1] + 0.1 * F.col("label")).cast("double").alias("y"))


def _model(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _training(spark, sf_dir)
        return surrogate.fit(rows, kind).predict(rows).select("seq_id", "mean", "std")

    return run


for _name, _kind in {"m02_ensemble": "ensemble", "m03_posterior_draws": "draws", "m04_mean_variance": "mean_variance", "m05_evidential": "evidential"}.items():
    SPECS[_name] = (_model(_kind), None)


@spec("m06_uncertainty_components")
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    return surrogate.fit(rows).components(rows).select("seq_id", "mean", "aleatoric", "epistemic", "total")


@spec("m08_model_per_objective")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    both = rows.withColumn("obj", F.lit("a")).unionByName(rows.withColumn("obj", F.lit("b")).withColumn("y", -F.col("y")))
    return surrogate.predict_each(surrogate.fit_each(both), rows)


@spec("m10_split", "select seq_id, row_number() over (order by {U:seq_id}, seq_id) <= (select cast(floor(count(*)*0.2) as bigint) from {vectors}) validation from {vectors}")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.split(fixture(spark, sf_dir, "vectors").select("seq_id"), 0.2)


@spec("m12_cross_validation")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.cross_validate(_training(spark, sf_dir), [{"width": w, "ridge": r} for w in (0, 16) for r in (0.1, 10.0)], folds=3)


@spec(
    "m13_trials",
    "select trial, width, round(ridge,6) ridge, origin from (select trial, width, ridge, 'again' origin from (select seq_id trial, 16*(seq_id%3) width, round(std,6) ridge, round(mean,6) nll from {predictions} where std is not null order by nll, trial limit 5)"
    " union all select seq_id, ([0,16,32])[cast(1+floor({U:seq_id,'width'}*3) as int)], power(10.0,-3+5*{U:seq_id,'ridge'}), 'fresh' from {vectors})",
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = fixture(spark, sf_dir, "predictions").where("std is not null").select(F.col("seq_id").alias("trial"), (16 * (F.col("seq_id") % 3)).alias("width"), F.round("std", 6).alias("ridge"), F.round("mean", 6).alias("nll"))
    return rounded(surrogate.trial_table(fixture(spark, sf_dir, "vectors").select(F.col("seq_id").alias("trial")), earlier=earlier), "ridge")


@spec("m14_tuned")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials of a tuning that begins with the best of an earlier one."""
    rows = _training(spark, sf_dir)
    _, first = surrogate.tuned(rows, 4)
    return surrogate.tuned(rows, 4, seed=43, earlier=first)[1]


@spec("a10_dispatch", "select seq_id, round(mean,6) acquisition from {predictions}")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(acquire.acquisition(fixture(spark, sf_dir, "predictions"), "mean").select("seq_id", "acquisition"), "acquisition")
