from __future__ import annotations

from matchloom.model import ROOT
from matchloom.sources import mappings as io
from matchloom.sources import ontology as on
from matchloom.streaming.labels import match_stream

OWL = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:obo="http://x#">
  <owl:Class rdf:about="http://purl.obolibrary.org/obo/A"><rdfs:label xml:lang="en">Red_Bolt</rdfs:label><rdfs:label>red bolt</rdfs:label>
    <obo:syn>Bolt, red</obo:syn><rdfs:subClassOf rdf:resource="{ROOT}"/></owl:Class>
  <owl:Class rdf:about="http://purl.obolibrary.org/obo/B"><rdfs:label>gear</rdfs:label><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/A"/>
    <rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
  <owl:Class rdf:about="http://purl.obolibrary.org/obo/C"/>
</rdf:RDF>"""


def maps(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, tgt string, score double")


def test_owl_and_bundle(spark, tmp_path):
    (p := tmp_path / "o.owl").write_text(OWL)
    classes, edges = on.read_owl(spark, str(p), "S", ("rdfs:label", "obo:syn"))
    assert {r["iri"]: r["labels"] for r in classes.collect()} == {"obo:A": ["red bolt", "bolt, red"], "obo:B": ["gear"], "obo:C": []}
    assert [(r["child"], r["parent"]) for r in edges.collect()] == [("obo:B", "obo:A")]
    bundle = on.Bundle.of(classes, edges)
    assert on.Bundle.load(spark, str(tmp_path / "b")) is None
    bundle.save(str(tmp_path / "b"))
    again = on.Bundle.load(spark, str(tmp_path / "b"))
    assert again.index.where("token = 'bolt' and iri = 'obo:A'").first()["dtf"] == 2
    assert on.class_labels(again.classes).count() == 3


def test_tsv(spark, tmp_path):
    p = str(tmp_path / "m.tsv")
    io.write_mappings(maps(spark, ("obo:a", "null", 0.5), ("obo:b", "n/a", 0.9)), p)
    assert {(r["src"], r["tgt"], r["score"]) for r in io.read_mappings(spark, p).collect()} == {("obo:a", "null", 0.5), ("obo:b", "n/a", 0.9)}
    assert io.read_mappings(spark, p, 0.9).count() == 1
    io.write_mappings(maps(spark, ("a", "b", 0.5)), p, 1.0)
    assert io.read_mappings(spark, p).first()["score"] == 1.0


def test_last_duplicate_wins(spark, tmp_path):
    (p := tmp_path / "d.tsv").write_text("Entity1\tEntity2\tValue\na\tb\t0.9\na\tb\t0.4\n")
    assert io.read_last_scores(spark, str(p)).first()["score"] == 0.4
    assert io.read_mappings(spark, str(p)).first()["score"] == 0.9


def test_rdf_round_trip_and_relations(spark, tmp_path):
    p = str(tmp_path / "a.rdf")
    io.write_rdf(maps(spark, ("http://purl.obolibrary.org/obo/A&1", "http://www.orpha.net/ORDO/B", 0.75)), p)
    rows = io.read_rdf(spark, p).collect()
    assert [(r["src"], r["tgt"], r["score"], r["relation"], r["legal"]) for r in rows] == [("obo:A&1", "ordo:B", 0.75, "=", True)]
    cell = '<map><Cell><entity1 rdf:resource="a{0}"/><entity2 rdf:resource="b"/><measure>1.0</measure><relation>{1}</relation></Cell></map>'
    body = "".join(cell.format(i, r) for i, r in enumerate(("=", "?", "&gt;", "&lt;", "%")))
    (q := tmp_path / "r.rdf").write_text(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">{body}</rdf:RDF>')
    assert {r["src"]: r["legal"] for r in io.read_rdf(spark, str(q)).collect()} == {"a0": True, "a1": False, "a2": True, "a3": True}
    io.save_rdf_as_tsv(spark, str(q), str(tmp_path / "r"))
    assert io.read_mappings(spark, str(tmp_path / "r_legal.tsv")).count() == 3


def test_pipe_lines(spark):
    lines = io.pipe_lines(maps(spark, ("obo:A", "ordo:B", 0.5)))
    assert lines.first()["value"] == "http://purl.obolibrary.org/obo/A|http://www.orpha.net/ORDO/B|=|0.5|CLS"
    bad = spark.createDataFrame([("a|b|=|0.5",), ("a|b|=|0.5|CLS|x",)], "value string")
    assert io.read_pipe(lines.unionByName(bad)).count() == 1


def test_repaired(spark, tmp_path):
    (p := tmp_path / "x.tsv").write_text("http://purl.obolibrary.org/obo/A\thttp://www.orpha.net/ORDO/B\t0.5\n")
    assert tuple(io.read_repaired(spark, str(p)).first()) == ("obo:A", "ordo:B", 0.5)


def test_log(spark):
    lines = ["[Time: 1][SRC: a][Class-idx: 0][Mapping: ('a', 'x', 9e-1)]", "[Time: 1][PID 3][SRC: a][Class-idx: 0][Mapping: ('a', 'y', 0.1)]", "[Time: 2][TGT: x][Class-idx: 1][Mapping: ('x', 'a', 0.5)]", "noise"]
    got = {tuple(r) for r in io.read_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("SRC", "a", "x", 0.9, 1), ("TGT", "a", "x", 0.5, 1)}


def test_label_pairs(spark, tmp_path):
    io.write_label_pairs(spark.createDataFrame([("a", "b", 1)], "sent1 string, sent2 string, label int"), str(tmp_path / "l"))
    assert spark.read.options(sep="\t", header=True).csv(str(tmp_path / "l")).first()["sent2"] == "b"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"iri": "s1", "label": "Red_Bolt", "ts": "2024-01-01T00:00:00"}\n' * 2 + '{"iri": "s2", "label": "x", "ts": "2024-01-01T00:00:01"}\n')
    target = spark.createDataFrame([("t1", "red bolt")], "iri string, label string")
    stream = spark.readStream.schema("iri string, label string, ts timestamp").json(str(tmp_path / "in"))
    q = match_stream(stream, target).writeStream.format("memory").queryName("matched").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["src"], r["tgt"]) for r in spark.table("matched").collect()] == [("s1", "t1")]
