"""Tables that the queries derive from the given ones, written once for both engines.

``{name}`` stands for a given table or another fixture; ``{U:key}`` for the hash uniform of seed 42; ``{mean:column}`` for the mean of a column; ``{o}`` for
the first list index; ``{g}`` for the flag that makes a regular-expression replacement global; ``{tiles}`` for the tiles of a sequence.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    # Letters are stripped before upper-casing, which differs between engines beyond ASCII.
    "sequences": "select doc_id seq_id, upper(regexp_replace(text,'[^acdefghiklmnpqrstvwyACDEFGHIKLMNPQRSTVWY]',''{g})) sequence from {documents}",
    # Tiles of 1 to 32 letters that cover every letter once.
    "peptides": "select seq_id protein_id, {tiles}",
    "predictions": "select l_partkey seq_id, cast(avg(l_quantity) as double) mean, cast(stddev_samp(l_quantity) as double) std from {lineitem} group by l_partkey",
    "predictions_multi": """select l_partkey seq_id, 'obj1' obj, cast({mean:l_quantity} as double) mean, cast(stddev_samp(l_quantity) as double) std from {lineitem} group by l_partkey
        union all select l_partkey seq_id, 'obj2' obj, cast({mean:l_discount} as double) mean, cast(stddev_samp(l_discount) as double) std from {lineitem} group by l_partkey""",
    "scores": """select l_partkey seq_id, cast(-2.0*avg(l_quantity) as double) interface_dg, cast(5.5+20.0*avg(l_discount) as double) distance_score,
        cast(-avg(l_extendedprice)/150.0 as double) rosetta_score, cast(3.0+300.0*avg(l_tax) as double) sequence_pae,
        cast(sum(case when l_returnflag='R' then 1 else 0 end) as double)/count(*) iptm,
        sum(case when l_linestatus='O' then 1 else 0 end) >= 12 in_binding_site from {lineitem} group by l_partkey""",
    # Structures of 100 vectors, so that pairs within structures grow with the table and not with its square.
    "atoms": """select cast(floor(vec_id/100) as bigint) structure_id, case when vec_id%2=0 then 'A' else 'B' end chain, vec_id,
        row_number() over (partition by cast(floor(vec_id/100) as bigint), vec_id%2 order by vec_id)-1 res_idx,
        20*cast(embedding[{o}] as double) x, 20*cast(embedding[{o}+1] as double) y, 20*cast(embedding[{o}+2] as double) z from {embeddings}""",
    # Backbones: chain A is a helix of 98.93 degrees and 1.541 a residue, shaken; chain B a cloud of residues. Every eleventh vector's residue lacks its O.
    "backbone": " union all ".join(
        f"""select structure_id, chain, res_idx+5 res_seq, {line}+4*res_idx line_no, '{name}' atom_name,
        case when chain='A' then {radius}*cos(radians(98.93*res_idx+{angle}))+0.2*a.x else {cloud[0]} end x,
        case when chain='A' then {radius}*sin(radians(98.93*res_idx+{angle}))+0.2*a.y else {cloud[1]} end y,
        case when chain='A' then 1.541*res_idx+{rise}+0.2*a.z else {cloud[2]} end z
        from {{atoms}} a join (select vec_id, {', '.join(f'cast(embedding[{{o}}+{k}] as double) e{k}' for k in range(3, 10))} from {{embeddings}}) e on a.vec_id=e.vec_id{" where a.vec_id % 11 <> 0" if name == "O" else ""}"""
        for line, (name, radius, angle, rise, cloud) in enumerate((
            ("N", 1.566, -26.65, -0.916, ("1.5*a.x", "1.5*a.y", "1.5*a.z")),
            ("CA", 2.291, 0.0, 0.0, ("1.5*a.x+6*e3", "1.5*a.y+6*e4", "1.5*a.z+6*e5")),
            ("C", 1.68, 26.9, 1.058, ("1.5*a.x+6*e3+6*e6", "1.5*a.y+6*e4+6*e7", "1.5*a.z+6*e5+6*e8")),
            ("O", 1.934, 20.68, 2.247, ("1.5*a.x+6*e3+6*e6+1.23*cos(10*e9)", "1.5*a.y+6*e4+6*e7+1.23*sin(10*e9)", "1.5*a.z+6*e5+6*e8")),
        ))
    ),
    "residues": "select structure_id, chain, res_idx, row_number() over (partition by structure_id order by chain, res_idx)-1 token_idx from {atoms}",
    "plddt": "select structure_id, token_idx, 100*{U:structure_id,token_idx} plddt from {residues}",
    "pae": "select i.structure_id, i.token_idx i, j.token_idx j, 30*{U:i.structure_id,i.token_idx,j.token_idx} pae from {residues} i join {residues} j on i.structure_id=j.structure_id",
    "site": "select structure_id, res_idx from {residues} where chain='A' and res_idx % 2 = 0",
    "score_log": "select ts, cast(floor(event_id/1000) as int) iteration, concat('S', user_id) sequence, event_type phase, cast(value as double) objective, event_id from {events}",
    "quality": "select sequence from (select distinct sequence from {peptides}) where length(sequence) > 5 and length(sequence) < 30 and list_max(list_transform(string_split('ACDEFGHIKLMNPQRSTVWY', ''), lambda a: length(sequence)-length(replace(sequence,a,''))))::double/length(sequence) <= 0.75 and not regexp_matches(sequence, '(AAAAAA|CCCCCC|DDDDDD|EEEEEE|FFFFFF|GGGGGG|HHHHHH|IIIIII|KKKKKK|LLLLLL|MMMMMM|NNNNNN|PPPPPP|QQQQQQ|RRRRRR|SSSSSS|TTTTTT|VVVVVV|WWWWWW|YYYYYY)')",
    "vectors": "select vec_id seq_id, embedding, label from {embeddings}",
}

_UNIFORM = {
    "spark": "((cast(conv(substr(md5(concat_ws('|',42,%s)),1,8),16,10) as double)+0.5)/4294967296.0D)",
    "duckdb": "((cast(cast('0x'||substr(md5(concat_ws('|',42,%s)),1,8) as bigint) as double)+0.5)/4294967296.0)",
}
# Sums of doubles depend on the order of rows, so in Spark equal means would differ in their last bits and ties wouldn't go by key. Numbers of at most six decimal
# places below 1e9 are added as whole millionths and divided once; where others are among them (or the sum overflows), it is the plain mean.
_MILLIONTHS = "case when abs({x}) < 1e9D and rint({x}*1e6D)/1e6D = {x} then cast(rint({x}*1e6D) as bigint) end"
_MEAN = {
    "spark": f"coalesce(case when count({_MILLIONTHS}) = count({{x}}) then try_divide(try_sum({_MILLIONTHS}), 1e6D*count({{x}})) end, avg({{x}}))",
    "duckdb": "avg({x})",
}
# Chunks of 100 letters, found in one pass, and the tiles of each; together they are the whole sequence.
_TILES = ((0, 1), (1, 4), (5, 5), (10, 6), (16, 9), (25, 14), (39, 29), (68, 32))
_CHUNK = "concat('.', chr(123), '1,100', chr(125))"
_CUTS = "(values " + ", ".join(f"({a}, {n})" for a, n in _TILES) + ") cuts(off, size)"
_TILE_STRUCTS = ", ".join(f"struct(100*b+{a}, substr(c, {a + 1}, {n}))" for a, n in _TILES)
_WORDS = {
    "spark": {
        "o": "0",
        "g": "",
        # Each tile is a compiled expression: a lambda over cuts would be interpreted for each. Nulls and empty sequences have no chunks.
        "tiles": f"t.start_pos, t.sequence from (select seq_id, inline(array({_TILE_STRUCTS})) as (start_pos, sequence) from (select seq_id, posexplode(regexp_extract_all(sequence, {_CHUNK}, 0)) as (b, c) from {{sequences}})) t where t.sequence <> ''",
    },
    "duckdb": {
        "o": "1",
        "g": ",'g'",
        "tiles": f"cast(100*(b-1)+off as int) start_pos, substr(c, off+1, size) sequence from (select seq_id, unnest(l) c, generate_subscripts(l, 1) b from (select seq_id, regexp_extract_all(sequence, {_CHUNK}) l from {{sequences}} where length(sequence) > 0)), {_CUTS} where off < length(c)",
    },
}


def render(sql: str, engine: str, sf_dir: str = "") -> str:
    """The text for an engine, with fixtures as subqueries and given tables as files (Spark) or views (DuckDB)."""

    def word(m: re.Match) -> str:
        name = m[1]
        if name.startswith("U:"):
            return _UNIFORM[engine] % name[2:]
        if name.startswith("mean:"):
            return _MEAN[engine].format(x=name[5:])
        if name in TABLES:
            return f"parquet.`{sf_dir}/{name}.parquet`" if engine == "spark" else name
        if name in FIXTURES:
            return f"({render(FIXTURES[name], engine, sf_dir)})"
        return render(_WORDS[engine][name], engine, sf_dir)

    return re.sub(r"\{([\w:,. ']+)\}", word, sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(render(f"select * from {{{name}}}", "spark", sf_dir))
