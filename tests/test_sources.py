from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandloom.operators import validation as D
from strandloom.plans import etl as E
from strandloom.sources import genomic as G
from strandloom.sources import tables as S
from strandloom.streaming import ingest


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_vcf(spark, tmp_path):
    path = _write(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\n1\t100\trs1\tA\tG,T\t.\tPASS\tFREQ=GnomAD:0.7,0.2,0.1|KG:.,.,0.5;DB\t.\n2\t7\t.\tC\tG\t.\tPASS\t.\t.\n")
    rows = G.dbsnp_frequencies(G.per_alt(G.read_vcf(spark, path))).orderBy("chrom", "alt").collect()
    assert [(r["alt"], r["allele_frequencies"]) for r in rows[:2]] == [("G", {"GnomAD": 0.2}), ("T", {"GnomAD": 0.1, "KG": 0.5})]
    assert rows[0]["info"]["DB"] == "true" and rows[2]["id"] is None
    assert G.search_vcf(G.read_vcf(spark, path), "chr1", 50, 100).count() == 1


def test_gff3(spark, tmp_path):
    lines = [
        "#!x", "1\te\tgene\t10\t90\t.\t.\t.\tID=gene:ENSG1;Name=ABC;biotype=protein_coding", "1\te\tmRNA\t10\t90\t.\t+\t.\tID=transcript:ENST1;Parent=gene:ENSG1;tag=basic,Ensembl_canonical",
        "1\te\texon\t10\t40\t.\t+\t.\tParent=transcript:ENST1;exon_id=ENSE1", "1\te\tCDS\t12\t30\t.\t+\t0\tID=CDS:ENSP1;Parent=transcript:ENST1;protein_id=ENSP1", "KI270\te\tgene\t1\t2\t.\t+\t.\tID=gene:ENSG9",
        "2\te\tgene\t1\t9\t.\t-\t.\tID=gene:ENSG2;biotype=artifact",
    ]
    rows = G.gene_models(G.read_gff3(spark, _write(tmp_path, "a.gff3", "\n".join(lines)))).collect()
    assert [(r["gene_id"], r["strand"], r["chromosome"]) for r in rows] == [("ENSG1", "+", "chr1")]
    t = rows[0]["transcripts"][0]
    assert t["is_canonical"] and t["exons"][0]["exon_id"] == "ENSE1" and t["proteins"] == ["ENSP1"]


def test_gaf_and_maps(spark, tmp_path):
    gaf = "!x\n" + "\n".join("\t".join(["U", "P1", "S", "q", "GO:1", "PMID:1", code, "a|b", *[""] * 9]) for code in ("IEA", "IEA", "IDA")) + "\n"
    assert len(G.evidence_sets(G.read_gaf(spark, _write(tmp_path, "a.gaf", gaf))).first()["evidence"]) == 2
    ids = G.read_id_mapping(spark, _write(tmp_path, "m.tsv", "P1\tEnsembl\tENSG1.2\nP1\tEnsembl\tENSG1.3\nP1\tOther\tx\n"))
    assert [tuple(r) for r in ids.collect()] == [("P1", "Ensembl", "ENSG1")]
    merges = G.read_merges(spark, _write(tmp_path, "m.json", '{"refsnp_id":"1","dbsnp1_merges":[],"merged_snapshot_data":{"merged_into":["2"]}}\n{"refsnp_id":"2","dbsnp1_merges":[],"merged_snapshot_data":{"merged_into":["3"]}}\n{"refsnp_id":"4","merged_snapshot_data":{"merged_into":[]}}\n'))
    assert {r[0]: r[1] for r in G.resolve_merges(merges).collect()} == {"rs1": "rs3", "rs2": "rs3"}


def test_delimited(spark, tmp_path):
    rows = S.read_delimited(spark, _write(tmp_path, "a.txt", "a;b\n x ;1\ny;2\n"))
    assert [tuple(r) for r in rows.collect()] == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="several values"):
        S.column_mapping(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k", "v", many=False).collect()


def test_schema_validation(spark):
    schema = {"required": ["id", "sex", "gone"], "additionalProperties": False, "properties": {"id": {}, "sex": {"enum": ["Male", "Female"]}, "md5": {"format": "md5sum"}, "age": {"type": "number", "minimum": 0}}}
    rows = spark.createDataFrame([(1, "a", "male", "0" * 32, "5"), (2, None, "x", "0", "-1"), (3, "c", None, None, "old")], "line int, id string, sex string, md5 string, age string")
    found = {}
    for r in D.validate(rows, schema, "line").collect():
        found.setdefault(r["line"], []).append(r["message"])
    assert sorted(found) == [2, 3] and len(found[2]) == 4 and len(found[3]) == 2
    assert D.file_errors(schema, ["id", "sex", "extra"]) == ["required column `gone` is missing", "column `extra` is not allowed"]


def test_plugins(spark, tmp_path):
    path = _write(tmp_path, "map.tsv", "1\t1000000\nMT\t16569\n")
    store = E.Warehouse(spark, f"file://{tmp_path}/warehouse")
    plugin = E.REGISTRY.get("chromosome_map")(path=path)
    assert E.run_plugin(plugin, store, E.Mode.DRY_RUN)[1] == {"genome_reference": 2}
    assert store.table("genome_reference") is None
    run, counts = E.run_plugin(plugin, store)
    assert counts == {"genome_reference": 2} and store.table("genome_reference").count() == 2
    assert E.run_plugin(plugin, store, resume=True)[1] == {"genome_reference": 0}
    E.run_plugin(plugin, store, E.Mode.UNDO, run_id=run)
    assert store.table("genome_reference").count() == 0
    assert {(r["operation"], r["n_runs"]) for r in E.tally(store).collect()} == {("DRY_RUN", 1), ("RUN", 2), ("UNDO", 1)}


def test_pipeline_plan(spark, tmp_path):
    stages = [E.Stage("a", [E.Task("x", "SHELL", command="true"), E.Task("y", "SHELL", command="true", deprecated=True)]), E.Stage("b", [E.Task("z", "SHELL", command="echo ${w} > /dev/null")], parallel=True)]
    names = lambda p: [f"{s.name}.{t.name}" for s, ts in p for t in ts]
    assert names(E.plan(stages)) == ["a.x", "b.z"]
    assert names(E.plan(stages, resume_at="b")) == ["b.z"]
    assert names(E.plan(stages, skip=["a.x"])) == ["b.z"]
    for bad in ({"only": ["a"], "skip": ["b"]}, {"only": ["nosuch"]}):
        with pytest.raises(ValueError):
            E.plan(stages, **bad)
    store = E.Warehouse(spark, f"file://{tmp_path}/w")
    assert E.run_pipeline(stages, store, {"w": 1}) == ["a.x", "b.z"]
    with pytest.raises(KeyError):
        E.interpolate("${missing}", {})
    assert E.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    rows = ingest.dropped_files(spark, f"{tmp_path}/in", schema)
    ingest.load_batches(rows, ingest.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    unique = ingest.distinct_in_bin(ingest.dropped_files(spark, f"{tmp_path}/in", schema), "ts", ["event_type"], "400 days")
    ingest.load_batches(unique, ingest.append_batches(f"{tmp_path}/u"), f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/u").select("event_type").distinct().count() == events.select("event_type").distinct().count()


def test_lookup_of_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [r["v"] for r in S.one_record(rows, ["v"], {"k": 1}).collect()] == ["a"] and S.one_record(rows, ["v"], {"k": 9}).count() == 0
    with pytest.raises(Exception, match="several rows"):
        S.one_record(rows, ["v"], {"k": 2}).collect()


def test_pathway_lines_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="six fields"):
        G.read_reactome(spark, _write(tmp_path, "r.txt", "ENSG1\tR-1\tx\n")).collect()


def test_hooks_of_a_run(spark, tmp_path):
    said = []

    class Hooked(E.Plugin):
        name, tables, key = "hooked", ("t",), "id"

        def extract(self, spark):
            return spark.range(3)

        def on_run_start(self, store, run_id):
            said.append(("start", run_id))

        def on_run_complete(self, store, run_id, counts):
            said.append(("complete", counts["t"]))

        def on_undo(self, store, run_id):
            said.append(("undo", store.table("t").count()))

    store = E.Warehouse(spark, str(tmp_path / "w"))
    run_id, _ = E.run_plugin(Hooked(), store)
    E.run_plugin(Hooked(), store, E.Mode.UNDO, run_id=run_id)
    assert said == [("start", run_id), ("complete", 3), ("undo", 3)]
