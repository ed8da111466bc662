"""Append-only logs partitioned by iteration, snapshots, upserts and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_iteration(rows: DataFrame, path: str, iteration: int, phase: str | None = None) -> None:
    """Writes an iteration's rows; a retry replaces them, so the log holds each iteration once."""
    out = rows.drop("iteration").withColumn("iteration", F.lit(iteration))
    if phase is not None:
        out = out.withColumn("phase", F.lit(phase))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All iterations; columns that were added later are null before."""
    return spark.read.option("mergeSchema", True).parquet(path)


def wide_objectives(objectives: DataFrame, names: list[str], key: str = "seq_id") -> DataFrame:
    """A column for each objective."""
    return objectives.groupBy(key).pivot("obj", names).agg(F.first("value"))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both under all columns, null where a row has none."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert_exact(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).dropDuplicates()


def save_embeddings(embeddings: DataFrame, path: str) -> None:
    """Written once; an existing table stays."""
    embeddings.write.mode("ignore").parquet(path)


def snapshot(tables: dict[str, DataFrame], folder: str, number: int) -> str:
    """Tables under ``folder/checkpoint_<number>`` and, last of all, a manifest of their names."""
    at = f"{folder}/checkpoint_{number}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, number) for n in tables], "table_name string, number int").write.mode("overwrite").parquet(f"{at}/manifest")
    return at


def missing_tables(manifest: DataFrame, required: list[str]) -> DataFrame:
    wanted = manifest.sparkSession.createDataFrame([(r,) for r in required], "table_name string")
    return wanted.join(manifest.select("table_name").distinct(), "table_name", "left_anti")


def design_results(designs: DataFrame, energies: DataFrame, samples: DataFrame) -> DataFrame:
    """Designs with energies on (sample, cycle) and samples on sample; ids that are no number are dropped."""
    rows = designs.where(F.col("sample_id").try_cast("long").isNotNull()).join(energies, ["sample_id", "cycle"], "left").join(samples, "sample_id", "left")
    first = ["sample_id", "cycle"]
    return rows.select(*first, *sorted(c for c in rows.columns if c not in first))


def write_fasta(rows: DataFrame, path: str, identifier: str = "protein_id", sequence: str = "sequence", target: str | None = None) -> None:
    """``>id`` and the sequence, behind its target and a colon if there is one."""
    body = F.col(sequence) if target is None else F.concat_ws(":", target, sequence)
    rows.select(F.concat(F.lit(">"), F.col(identifier).cast("string"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def append_predictions(predictions: DataFrame, path: str, iteration: int, key: str = "seq_id") -> None:
    """Mean and deviation of each key (and objective, if there are several), sorted by key within files."""
    columns = [c for c in (key, "obj", "mean", "std") if c in predictions.columns]
    append_iteration(predictions.select(*columns).sortWithinPartitions(*columns[:-2]), path, iteration)


def append_acquisition(values: DataFrame, path: str, iteration: int, name: str, key: str = "seq_id") -> None:
    """Acquisition values with the function's name, sorted by key within files."""
    append_iteration(values.select(key, F.lit(name).alias("function"), "acquisition").sortWithinPartitions(key), path, iteration)


def append_parameters(spark: SparkSession, parameters: dict, path: str, iteration: int) -> None:
    """One row of parameters, their names sorted, all as text; lists are joined by commas."""
    text = lambda v: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    names = sorted(parameters)
    row = spark.createDataFrame([tuple(text(parameters[n]) for n in names)], ", ".join(f"{n} string" for n in names))
    append_iteration(row, path, iteration)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def next_snapshot(spark: SparkSession, folder: str) -> int:
    """One more than the largest number of a ``checkpoint_`` folder; 1 where there is none."""
    fs, p = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n.removeprefix("checkpoint_")) for n in names if n.startswith("checkpoint_") and n.removeprefix("checkpoint_").isdigit()), default=0) + 1


def log_path(spark: SparkSession, path: str, policy: str = "error") -> str:
    """Where a new log goes if ``path`` is taken: an error, the same path to be overwritten, or the first free one of ``path_1``, ``path_2`` and so on."""
    if policy not in ("error", "overwrite", "unique"):
        raise ValueError(f"no policy called {policy}")
    if not exists(spark, path) or policy == "overwrite":
        return path
    if policy == "error":
        raise FileExistsError(path)
    k = 1
    while exists(spark, f"{path}_{k}"):
        k += 1
    return f"{path}_{k}"


def _by_structure(lines: DataFrame, path: str) -> None:
    """(structure_id, place, value) as one text file in a folder of each structure."""
    lines.repartition("structure_id").sortWithinPartitions("structure_id", "place").select("structure_id", "value").write.mode("overwrite").partitionBy("structure_id").text(path)


def write_pdb(atoms: DataFrame, path: str) -> None:
    """ATOM and HETATM lines in fixed columns, in the order of line_no, a folder for each structure."""
    serial = F.pmod(F.col("line_no") + 1, F.lit(100000))
    group = F.when(F.col("hetflag"), "HETATM").otherwise("ATOM  ")
    value = F.format_string("%s%5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00           %s", group, serial, "atom_name", "resname", "chain", "res_seq", "x", "y", "z", F.substring("atom_name", 1, 1))
    _by_structure(atoms.select("structure_id", F.col("line_no").cast("long").alias("place"), value.alias("value")), path)


CIF_COLUMNS = ("group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id", "pdbx_PDB_model_num")


def write_mmcif(atoms: DataFrame, path: str) -> None:
    """The atom_site loop with a line for each atom, a folder for each structure."""
    head = ["data_structure", "loop_", *(f"_atom_site.{c}" for c in CIF_COLUMNS)]
    group = F.when(F.col("hetflag"), "HETATM").otherwise("ATOM")
    value = F.format_string("%s %d %s %s %s %d %.3f %.3f %.3f %d %s %d", group, F.col("line_no") + 1, "atom_name", "resname", "chain", "res_seq", "x", "y", "z", "res_seq", "chain", F.col("model") + 1)
    rows = atoms.select("structure_id", F.col("line_no").cast("long").alias("place"), value.alias("value"))
    first = atoms.select("structure_id").distinct().select("structure_id", F.posexplode(F.array(*map(F.lit, head))).alias("at", "value")).select("structure_id", (F.col("at") - len(head)).cast("long").alias("place"), "value")
    _by_structure(first.unionByName(rows), path)
