"""Readers on small files, and superposition on moved copies."""

import math

import pytest
from pyspark.sql import functions as F

from seqspark.operators import overlap
from seqspark.plans import logs
from seqspark.sources import readers, sinks

ATOM = "ATOM  {:5d} {:^4s} {:3s} {:1s}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    atoms = [ATOM.format(1, "N", "ALA", "A", 5, 1, 2, 3), ATOM.format(2, "CA", "ALA", "A", 5, 2, 2, 3), ATOM.format(3, "CA", "GLY", "A", 6, -1.5, 0, 4), ATOM.format(4, "CA", "LYS", "B", 1, 9, 9, 9), ATOM.format(5, "O", "HOH", "A", 99, 0, 0, 0).replace("ATOM  ", "HETATM")]
    (d / "one.pdb").write_text("HEADER\nMODEL        1\n" + "".join(atoms) + "ENDMDL\nMODEL        2\n" + atoms[1] + "ENDMDL\nEND\n")
    names = ["group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id", "pdbx_PDB_model_num"]
    (d / "two.cif").write_text("data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + "ATOM 1 CA TRP A 1 1.0 2.0 3.0 17 H 1\nATOM 2 \"C1'\" TRP A 1 1.5 2.0 3.0 17 H 1\nHETATM 3 O HOH B . 0 0 0 99 W 1\n#\n")
    (d / "p.fasta").write_text(">a x\nACD\nEFG\n>b\nKKK\n>a x\nLLL\n")
    (d / "m.json").write_text('{"peptide_sequence": "ACD", "iptm": 0.5, "plddt_vector": [1.0, 3.0], "pae_matrix": [[1.0, 2.0], [3.0, 4.0]]}')
    (d / "sample_12.fa").write_text(">native\nAAA\n>T=0.1, score=0.5, global_score=0.6, seq_recovery=0.25\nCCD/EE\n")
    (d / "s.csv").write_text('sample_id,length,hotspots\n1,20,"A1,A2"\n')
    return d


def test_pdb(spark, folder):
    atoms = readers.structures(spark, f"{folder}/one.pdb")
    rows = atoms.orderBy("line_no").collect()
    assert [(r.model, r.chain, r.res_seq, r.atom_name, r.hetflag) for r in rows] == [(0, "A", 5, "N", False), (0, "A", 5, "CA", False), (0, "A", 6, "CA", False), (0, "B", 1, "CA", False), (0, "A", 99, "O", True), (1, "A", 5, "CA", False)]
    assert (rows[2].x, rows[2].z) == (-1.5, 4.0)
    chains = {r.chain: (r.sequence, r.start) for r in readers.chain_sequences(atoms).collect()}
    assert chains == {"A": ("AG", 5), "B": ("K", 1)}
    assert readers.main_chain(readers.chain_sequences(atoms)).first().chain == "A"


def test_mmcif(spark, folder):
    rows = readers.structures(spark, f"{folder}/two.cif").orderBy("line_no").collect()
    assert [(r.chain, r.res_seq, r.resname, r.atom_name, r.hetflag) for r in rows] == [("H", 17, "TRP", "CA", False), ("H", 17, "TRP", "C1'", False), ("W", 99, "HOH", "O", True)]
    with pytest.raises(ValueError):
        readers.structures(spark, "x.txt")


def test_text_files(spark, folder):
    assert dict(readers.fasta(spark, f"{folder}/p.fasta").collect()) == {"a x": "LLL", "b": "KKK"}
    m = readers.metrics_json(spark, f"{folder}/m.json").first()
    assert (m.sequence, m.iptm, m.plddt, m.pae) == ("ACD", 0.5, [1.0, 3.0], [[1.0, 2.0], [3.0, 4.0]])
    d = readers.design_fasta(spark, f"{folder}/sample_12.fa").first()
    assert (d.sample_id, d.sequence, d.score, d.seq_recovery) == (12, "CCD", 0.5, 0.25)
    assert readers.samples_csv(spark, f"{folder}/s.csv").first().hotspots == ["A1", "A2"]


def test_designs_of_many_samples_in_a_file(spark, tmp_path):
    text = "".join(f">sample_{i}, native, score=9\nAAA\n>T=0.1, score=0.{i}, global_score=1.5, seq_recovery=0.25\nCC\nD/EE\n" + ">T=0.1, sample=2, score=7\nKKK\n" * (i % 2) for i in range(1, 6)) + ">sample_6, native\nAAA\n"
    (tmp_path / "designs.fa").write_text(text)
    rows = readers.design_fasta(spark, str(tmp_path / "designs.fa"), pooled=True).orderBy("sample_id").collect()
    assert [(r.sample_id, r.sequence, r.score, r.global_score, r.seq_recovery) for r in rows] == [(i, "CCD", i / 10, 1.5, 0.25) for i in range(1, 6)]


def test_designs_write_few_files(spark):
    from seqspark.plans import files

    rows = files.s08(spark, "/root/testdata/sf0.001")
    assert rows.count() == 150
    assert len(rows.inputFiles()) <= 4 and all("structure_id=" not in f for f in rows.inputFiles())


def test_property_table(spark):
    wide = spark.createDataFrame([("good", "1.0", "2.0"), ("bad", "1", "NA")], "property string, A string, C string")
    assert {tuple(r) for r in readers.property_table(wide).collect()} == {("good", "A", 1.0), ("good", "C", 2.0)}


def test_appended_stream_goes_to_files(spark):
    rows = spark.range(20).select("id", F.timestamp_seconds("id").alias("ts"))
    got = logs._streamed(spark, rows, lambda df: df.select("id"), "append")
    assert len(got.inputFiles()) > 0 and sorted(r.id for r in got.collect()) == list(range(20))
    assert logs._streamed(spark, rows.limit(0), lambda df: df.select("id"), "append").count() == 0


def test_log_is_idempotent_and_search_resumes(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "seq_id long, objective double")
    for _ in range(2):
        sinks.append_iteration(rows, path, 3, "x")
    assert sinks.read_log(spark, path).count() == 2
    at = sinks.snapshot({"scores": rows}, f"file://{tmp_path}", 1)
    assert [r[0] for r in sinks.missing_tables(spark.read.parquet(f"{at}/manifest"), ["scores", "models"]).collect()] == ["models"]


def test_superposition_undoes_a_turn(spark):
    points = [(i, math.cos(i), math.sin(2 * i), 0.3 * i) for i in range(8)]
    chain = lambda i: "A" if i < 5 else "B"
    reference = spark.createDataFrame([("s", chain(i), i, x, y, z) for i, x, y, z in points], "structure_id string, chain string, res_idx int, x double, y double, z double")
    a = 0.7
    turned = spark.createDataFrame([("s", m, chain(i), i, x * math.cos(a) - y * math.sin(a) + 3, x * math.sin(a) + y * math.cos(a) - 1, z + (2.0 if i >= 5 else 0) * (m - 1)) for m in (1, 2) for i, x, y, z in points], "structure_id string, model int, chain string, res_idx int, x double, y double, z double")
    got = {r.model: r.rmsd for r in overlap.superposed_rmsd(turned, reference).collect()}
    assert got[1] == pytest.approx(0, abs=1e-9) and got[2] == pytest.approx(2.0)
    r = overlap.intra_model_rmsd(turned).first()
    assert (r.n_models, r.mean_rmsd) == (2, pytest.approx(2.0))
    few = overlap.superposed_rmsd(turned.where(F.col("res_idx") != 0).where("res_idx in (1, 2, 6)"), reference).collect()
    assert all(r.rmsd is None for r in few)


def test_requested_scores():
    assert overlap.required_scores(["a"], ["a", "b"]) == ["a"]
    with pytest.raises(ValueError, match="c"):
        overlap.required_scores(["c"], ["a"])
