"""Readers of sequence, structure, metric and log files as tables; a folder is read at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Three-letter names of the 20 amino acids.
LETTERS = {"ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L", "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y"}
ATOM_COLUMNS = ["structure_id", "model", "line_no", "hetflag", "chain", "res_seq", "icode", "resname", "atom_name", "x", "y", "z"]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, sequence): a record's header without ``>`` and its lines joined. Of records with one header the last in file order stands."""
    records = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0").withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    parts = F.split(F.col("value"), "\r?\n", 2)
    rows = records.select(F.trim(parts[0]).alias("protein_id"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"), "file", "at")
    return rows.groupBy("protein_id").agg(F.max_by("sequence", F.struct("file", "at")).alias("sequence"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their structure's id: that of a folder ``structure_id=...``, else the file's name without its ending."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return files.select((F.col("structure_id").cast("string") if "structure_id" in files.columns else name).alias("structure_id"), "value")


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files: fixed columns of ATOM and HETATM lines, with the model they stand in (from 0)."""
    lines = _files(spark, path).select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM", "MODEL ") | F.col("line").startswith("MODEL"))
    order = Window.partitionBy("structure_id").orderBy("line_no")
    lines = lines.withColumn("models", F.sum(F.col("line").startswith("MODEL").cast("int")).over(order)).where(~F.col("line").startswith("MODEL"))
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    number = lambda a, n: cut(a, n).cast("double")
    het = F.substring("line", 1, 6) == "HETATM"
    return lines.select("structure_id", F.greatest(F.col("models") - 1, F.lit(0)).cast("int").alias("model"), "line_no", het.alias("hetflag"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("res_seq"), cut(27, 1).alias("icode"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom_name"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"))


def mmcif(spark: SparkSession, path: str, author_numbers: bool = True) -> DataFrame:
    """Atoms of mmCIF files: rows of the atom_site loop, whose columns are found by name."""
    lines = _files(spark, path).select("structure_id", F.split("value", "\r?\n").alias("lines"))
    names = F.transform(F.filter("lines", lambda x: x.startswith("_atom_site.")), lambda x: F.trim(F.regexp_replace(x, r"^_atom_site\.", "")))
    rows = lines.select("structure_id", names.alias("names"), F.posexplode("lines").alias("line_no", "line")).where(F.col("line").rlike("^(ATOM|HETATM)\\s"))
    rows = rows.withColumn("field", F.map_from_arrays("names", F.slice(F.transform(F.regexp_extract_all("line", F.lit(r"('[^']*'|\"[^\"]*\"|\S+)"), 1), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", "")), F.lit(1), F.size("names"))))
    get = lambda *keys: F.coalesce(*(F.col("field")[k] for k in keys))
    chain, seq = (("auth_asym_id", "label_asym_id"), ("auth_seq_id", "label_seq_id")) if author_numbers else (("label_asym_id",), ("label_seq_id",))
    model = F.coalesce(get("pdbx_PDB_model_num").cast("int") - 1, F.lit(0))
    icode = F.when(get("pdbx_PDB_ins_code").isin("?", "."), "").otherwise(F.coalesce(get("pdbx_PDB_ins_code"), F.lit("")))
    return rows.select("structure_id", model.alias("model"), "line_no", (get("group_PDB") == "HETATM").alias("hetflag"), get(*chain).alias("chain"), get(*seq).try_cast("int").alias("res_seq"), icode.alias("icode"), get("label_comp_id").alias("resname"), get("label_atom_id").alias("atom_name"), *(get(f"Cartn_{c}").cast("double").alias(c) for c in "xyz"))


def structures(spark: SparkSession, path: str) -> DataFrame:
    """Atoms by the kind of file, which its ending tells; an unknown ending is an error."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("pdb",):
        return pdb(spark, path)
    if ending in ("cif", "pdbx", "mmcif"):
        return mmcif(spark, path)
    raise ValueError(f"no reader for files that end in .{ending}")


def residues(atoms: DataFrame, first_model: bool = True) -> DataFrame:
    """(structure_id, chain, res_seq, icode, resname, aa, token_idx, res_idx) of ATOM residues in file order; token_idx counts over chains, res_idx within."""
    rows = atoms.where(~F.col("hetflag"))
    if first_model:
        rows = rows.where(F.col("model") == 0)
    one = rows.groupBy("structure_id", "chain", "res_seq", "icode").agg(F.first("resname").alias("resname"), F.min("line_no").alias("line_no"))
    aa = F.coalesce(F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))[F.col("resname")], F.lit("X"))
    order = lambda *by: F.row_number().over(Window.partitionBy("structure_id", *by).orderBy("line_no")) - 1
    return one.select("structure_id", "chain", "res_seq", "icode", "resname", aa.alias("aa"), order().alias("token_idx"), order("chain").alias("res_idx"))


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """(structure_id, chain, sequence, start) with the number of the chain's first residue."""
    ordered = F.array_sort(F.collect_list(F.struct("res_idx", "aa")))
    return residues(atoms).groupBy("structure_id", "chain").agg(F.array_join(F.transform(ordered, lambda x: x["aa"]), "").alias("sequence"), F.min_by("res_seq", "res_idx").alias("start"))


def main_chain(sequences: DataFrame) -> DataFrame:
    """The longest chain of each structure, the first of equal ones."""
    order = Window.partitionBy("structure_id").orderBy(F.desc(F.length("sequence")), "chain")
    return sequences.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def metrics_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """sequence, iptm, ptm, plddt and pae of metric files, under any of their names; with structure_id where files lie in folders ``structure_id=...``."""
    schema = "sequence string, peptide_sequence string, sequences string, iptm double, ptm double, plddt array<double>, plddt_vector array<double>, pae array<array<double>>, pae_matrix array<array<double>>"
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    pick = lambda *names: F.coalesce(*names)
    own = [F.col("structure_id").cast("string").alias("structure_id")] if "structure_id" in df.columns else []
    return df.select(*own, pick("sequence", "peptide_sequence", "sequences").alias("sequence"), "iptm", "ptm", pick("plddt", "plddt_vector").alias("plddt"), pick("pae", "pae_matrix").alias("pae"))


def design_fasta(spark: SparkSession, path: str, pooled: bool = False) -> DataFrame:
    """(sample_id, sequence, score, global_score, seq_recovery) from the second record of each design file; the sequence ends before a slash.

    ``pooled``: a file holds any number of samples, each begun by a native record whose header is ``>sample_N``; the record after it is the design.
    """
    if pooled:  # a row for each sample, not for each file, and large files are split
        parts = F.split(F.concat(F.lit("sample_"), "value"), ">")
        second = spark.read.option("lineSep", ">sample_").text(path).where(F.col("value").rlike(r"^\d")).select(parts[0].alias("structure_id"), F.get(parts, F.lit(1)).alias("record"))
    else:
        parts = F.split("value", ">")
        second = _files(spark, path).select("structure_id", F.get(parts, F.lit(2)).alias("record"))
    value = lambda k: F.regexp_extract("record", rf"(?:^|[ ,]){k}=([-+.\deE]+)", 1).try_cast("double").alias(k)
    body = F.regexp_replace(F.get(F.split("record", "\n", 2), F.lit(1)), r"\s", "")
    return second.where("record is not null").select(F.regexp_extract("structure_id", r"sample_(\d+)", 1).try_cast("int").alias("sample_id"), F.split(body, "/")[0].alias("sequence"), value("score"), value("global_score"), value("seq_recovery"))


def samples_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).schema("sample_id int, length int, hotspots string").csv(path)
    return df.withColumn("hotspots", F.transform(F.split("hotspots", ","), lambda x: F.trim(x)))


def peptides_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("seq_id long, sequence string").csv(path)


def property_table(wide: DataFrame, name: str = "property") -> DataFrame:
    """(property, aa, value) of a table with a column for each letter; properties with a missing cell are dropped."""
    letters = [c for c in wide.columns if c != name]
    whole = wide
    for c in letters:
        whole = whole.where(F.col(c).try_cast("double").isNotNull())
    return whole.select(name, *(F.col(c).cast("double").alias(c) for c in letters)).unpivot([name], letters, "aa", "value")


def existing_results(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(target, sequence, method) of result files in folders called TARGET_SEQUENCE, with or without ``name=`` before it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/(?:name=)?([^/]+)_([A-Z]+)/[^/]+$", 1).alias("target"), F.regexp_extract("path", r"/(?:name=)?([^/]+)_([A-Z]+)/[^/]+$", 2).alias("sequence"))
    return found.where("sequence <> ''").distinct().withColumn("method", F.lit(method))


def picked_models(files: DataFrame) -> DataFrame:
    """One file for each (complex_id, rank_no), relaxed before unrelaxed, with ranks renumbered from 1."""
    best = Window.partitionBy("complex_id", "rank_no").orderBy(F.desc("relaxed"), "file")
    rows = files.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return rows.withColumn("model_no", F.row_number().over(Window.partitionBy("complex_id").orderBy("rank_no")))


def best_model(models: DataFrame) -> DataFrame:
    """Models of each complex in order of confidence (missing counts as 0); the first of equal ones stays first."""
    order = Window.partitionBy("complex_id").orderBy(F.desc(F.coalesce("iptm", F.lit(0.0))), "model_id")
    return models.withColumn("place", F.row_number().over(order))


def latest_parameters(log: DataFrame, drop: Column | None = None) -> DataFrame:
    """Last row of a parameter log without its bookkeeping columns, numbers as numbers."""
    keep = [c for c in log.columns if c not in ("timestamp", "iteration", "phase")]
    last = log.orderBy(F.desc("iteration"), *keep).limit(1)  # an iteration has one row; of more the first by their values
    return last.select(*(F.coalesce(F.col(c).try_cast("double").cast("string"), F.col(c).cast("string")).alias(c) for c in keep))


def typed_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV log under a schema; empty cells are null, gzip and plain files may be mixed."""
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)
