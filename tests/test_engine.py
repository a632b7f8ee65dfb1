import gzip
import json

from pyspark.sql import functions as F

from factloom.engine import Engine, ExternalTranslator
from factloom.sources import files
from factloom.streaming import ingest


def test_ingest_query_reset(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"))
    assert e.health()["statements"] == 0
    r = e.ingest(["The wheel is part of a car. A hammer is used for nails.", "Rex is a dog."]).first()
    assert (r.added, r.rejected_count, r.status) == (3, 0, "success")
    assert e.query("Is the wheel part of a car?")["status"] == "well_aligned" and e.query("Is the wheel part of a car?")["answers"]
    assert e.query("Hm")["status"] == "no_query"
    rule = "(: r (Implication (Premises (IsA $x dog)) (Conclusions (IsA $x animal))) (STV 1.0 0.9))"
    assert e.add(spark.createDataFrame([(rule,), ("bad",)], "stmt string")).count() == 1
    assert [x["$who"] for x in e.goal("(: $prf (IsA $who animal) $tv)").collect()] == ["rex"]
    assert e.retrieve("A hammer is used for nails.", 1).first().nl == "A hammer is used for nails."
    assert e.context(2).count() == 2
    e.reset("atomspace")
    assert e.health()["statements"] == 0 and e.stored().count() == 3
    e.reset()
    assert e.stored().count() == 0


def test_external_translator(spark, tmp_path):
    t = ExternalTranslator(lambda chunks: [[f"(: n (Said x{len(c)}) (STV 1 1))"] for c in chunks], lambda q: "(: $prf (Said $x) $tv)")
    e = Engine(spark, str(tmp_path / "kb"), t)
    e.ingest(["Hello."])
    assert e.query("?")["answers"][0]["$x"] == "x6"


def test_planned_questions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"), source_atoms=5)
    e.ingest(["The wheel is part of the car.", "A hammer is used for nails."])
    got = e.query("Are wheels part of cars?")
    assert (got["query_status"], got["executed_query"], got["answer"]) == ("well_aligned", "(: $prf (PartOf wheel car) $tv)", "yes")
    assert got["candidate_count"] >= 1 and got["executed_candidate_index"] == 0 and not got["fallback_used"] and got["reasoning_seconds"] >= 0
    lost = e.query("Is the moon part of the car?")
    assert lost["answer_count"] == 0 and lost["answer"]
    open_ = Engine(spark, str(tmp_path / "kb"), ExternalTranslator(lambda c: [[] for _ in c], lambda q: "(: $prf (PartOf $x car) $tv)"))
    weak = open_.query("Is the wheel part of something?")
    assert weak["query_status"] == "weakly_aligned" and weak["answers"][0]["$x"] == "wheel"
    off = Engine(spark, str(tmp_path / "kb"), open_.translator, answers=False, fallback=False)
    assert off.query("What is part of the car?")["answer"] == ""


def test_background_and_bad_rules(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"))
    rows = [("/r/PartOf", "/c/en/tooth", "/c/en/gear", '{"weight": 3.0}'), ("/r/IsA", "/c/en/gear", "/c/en/part", '{"weight": 2.5}'), ("/r/IsA", "/c/en/x", "/c/en/y", '{"weight": 0.5}')]
    raw = spark.createDataFrame(rows, "relation string, start_uri string, end_uri string, metadata_json string")
    progress = e.load_triples(raw)
    assert progress["loaded"] and progress["indexed_count"] == progress["expected_count"] == 2
    assert e.load_triples(raw)["loaded"] is False and e.sizes() == {"statements": 0, "background": 2, "vectors": 2, "by_source": {"conceptnet": 2}}
    assert e.goal("(: $prf (PartOf tooth gear) $tv)").count() == 1 and e.goal("(: $prf (PartOf Tooth Gears) $tv)").count() == 1
    bad = "(: b (Implication (Premises (P (Q $x))) (Conclusions (R $x))) (STV 1 1))"
    good = "(: g (Implication (Premises (PartOf $a $b) (IsA $b part)) (Conclusions (Small $a))) (STV 1.0 0.9))"
    cross = "(: c (Implication (Premises (PartOf $a $b) (IsA $c part)) (Conclusions (Small $c))) (STV 1.0 0.9))"
    e.add(spark.createDataFrame([(bad,), (good,), (cross,), ("(: n (Not (Small gear)) (STV 1.0 0.7))",)], "stmt string"))
    assert [r["$a"] for r in e.goal("(: $prf (Small $a) $tv)").collect()] == ["tooth"] and len(e.skipped_rules) == 2
    assert [r["$a"] for r in e.goal("(: $prf (Not (Small $a)) $tv)").collect()] == ["gear"]
    assert e.prove("no goal")[1] == 0 and e.health()["status"] == "degraded"
    e.reset(keep_background=True)
    assert e.sizes()["statements"] == 0 and e.sizes()["background"] == 2 and e.sizes()["vectors"] == 2 and e.health()["status"] == "ok"
    e.delete_by_source("conceptnet")
    assert e.sizes()["vectors"] == 0


def test_translators(spark, tmp_path):
    from factloom.engine import HybridTranslator, compare
    from factloom.translators import CanonicalTranslator, ExtractionTranslator, MergingTranslator, RememberingTranslator, translator

    def extract(chunks):
        return [[{"cls": "fact", "attributes": {"predicate": "likes", "subject": "Rex", "object": "bones"}, "alignment": "MATCH_EXACT"}, {"cls": "rule", "attributes": {"head_predicate": "happy", "head_args": "$x", "body": "(and (likes $x bones) (not (sad $x)))"}}] if "likes" in c else [] for c in chunks]

    first = ExtractionTranslator(extract)
    second = ExternalTranslator(lambda chunks: [[f"(: n (Words w{len(c.split())}) (STV 1 1))"] for c in chunks], lambda q: "(: $prf (Words $n) $tv)")
    chunks = spark.createDataFrame([(1, 0, "I know Rex likes bones. Ann and Rex eat."), (1, 1, "No match here.")], "doc_id long, chunk_no int, chunk string")
    got = {(r.chunk_no, r.stmt) for r in HybridTranslator(first, second).statements(chunks).collect()}
    assert got == {
        (0, "(: rex_bone_likes_fact (Likes rex bone) (STV 1.0 1.0))"),
        (0, "(: x_happy_rule (Implication (Premises (Likes $x bone) (Not (Sad $x))) (Conclusions (Happy $x))) (STV 1.0 1.0))"),
        (1, "(: n (Words w3) (STV 1 1))"),
    }
    assert first.goals("Who likes it?") == ["(: $prf (Likes rex bone) $tv)"]
    assert HybridTranslator(first, second, "second").goals("likes")[0].startswith("(: $prf (Words")
    only = HybridTranslator(first, second, "second_only")
    assert only.goals("likes") == second.goals("likes") and only.retry("likes", "") == first.goals("likes")
    e = Engine(spark, str(tmp_path / "kb"), only)
    e.add(spark.createDataFrame([("(: f (Likes rex bone) (STV 1 1))",)], "stmt string"))
    asked = e.query("Who likes bones?")
    assert asked["retry_used"] and asked["answer_count"] == 1 and asked["candidate_count"] == 2
    raw = ExternalTranslator(lambda chunks: [["(: s1 (isa Dogs Animals) (STV 1 1))", "(: s1  (isa Dogs Animals) (STV 1 1))", "(: bad (P $x) (STV 1 1))"] for _ in chunks], lambda q: "(: $prf (is_a dogs $x) $tv)")
    canonical = CanonicalTranslator(raw)
    assert {r.stmt for r in canonical.statements(chunks).collect()} == {"(: s1 (IsA dog animal) (STV 1 1))"}
    assert canonical.goals("What are dogs?") == ["(: $prf (IsA dog $x) $tv)"]
    assert MergingTranslator(second, second).statements(chunks).count() == 2
    kept = RememberingTranslator(second)
    kept.statements(chunks)
    assert list(kept.heads) == ["Words"]
    case = {"name": "one", "texts": ["Rex is a dog."], "question": "Is Rex part of a dog?", "expected_proof": False}
    rows = compare(spark, [case, case | {"name": "two", "texts": ["The tail is part of a dog."], "question": "Is the tail part of a dog?", "expected_proof": True}], {"pattern": Engine(spark, str(tmp_path / "c"))})
    assert [(r.name, r.proof_found, r.expected) for r in rows.orderBy("name").collect()] == [("one", False, False), ("two", True, True)]
    import pytest

    with pytest.raises(ValueError):
        translator("nobody")


def test_many_questions_and_item_counters(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "kb"))
    texts = spark.createDataFrame([(1, "A hammer is used for nails. A saw is used for wood."), (2, "Nothing to say"), (3, "The tooth is part of a gear.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in e.ingest_items(texts).collect()}
    assert (rows[1].n_atoms, rows[1].status, rows[2].status, rows[3].chunk_count) == (2, "success", "failed", 1)
    asked = [(1, "Is a tooth part of a gear?", "(: $prf (PartOf tooth gear) $tv)"), (2, "Is a saw used for something?", "(: $prf (UsedFor saw $x) $tv)"), (3, "Is a cat with a tooth part of a gear?", "(: $prf (PartOf cat gear) $tv)")]
    got = {r.question: r for r in e.query_many(spark.createDataFrame(asked, "goal_id long, question string, goal string")).collect()}
    assert got[asked[0][1]].status == "well_aligned" and got[asked[0][1]].executed == asked[0][2]
    assert got[asked[1][1]].executed == "(: $prf (UsedFor saw wood) $tv)" and got[asked[1][1]].status == "weakly_aligned"
    assert got[asked[2][1]].executed == "(: $prf (PartOf tooth gear) $tv)" and got[asked[2][1]].fallback_used


def test_result_artifacts(spark, tmp_path):
    from factloom.operators import metrics

    q = lambda a, b: {"query": {"original_query": a, "executed_query": b, "query_status": "well_aligned", "fallback_used": a != b, "reasoning_seconds": 1.5}}
    g = "(: $prf ({} a b) $tv)"
    data = {"results": {"x": [
        {"case": {"name": "1"}, "timing": {"ingest_seconds": 1.0, "query_seconds": 2.0}, "end_to_end": q(g.format("P"), g.format("P")), "proof_found": True},
        {"case": {"name": "2"}, "timing": {"query_seconds": 4.0}, "end_to_end": q(g.format("P"), "(: $prf (Not (Q a)) $tv)"), "proof_found": True},
        {"case": {"name": "3"}, "error": "x"},
    ]}}
    (tmp_path / "r.json").write_text(json.dumps(data))
    rows = files.results(spark, str(tmp_path / "r.json"))
    row = metrics.analysis_summary(rows).first()
    assert (row.parser, row.cases, row.proofs, row.proxy_rate, row.unparsed_heads, row.median_ingest_plus_query, row.median_reasoning_seconds) == ("x", 3, 2, 0.5, 0, 3.0, 1.5)
    big = tmp_path / "s.tsv"
    big.write_text("".join(f"u\t/r/IsA\t/c/en/a{i}\t/c/en/b\t{{}}\n" for i in range(5)))
    some, scanned = files.scanned_triples(spark, str(big), 3)
    assert (some.count(), scanned) == (3, 4) and files.scanned_triples(spark, str(big), 5)[1] == 5


def test_sources(spark, tmp_path):
    p = tmp_path / "t.tsv.gz"
    p.write_bytes(gzip.compress(b"u\t/r/IsA\t/c/en/a\t/c/en/b\t{}\nshort\tline\nu\t/r/IsA\t/c/en/c\t/c/en/d\t{}\textra\n"))
    assert files.triples(spark, str(p)).count() == 2 and files.triples(spark, str(p), max_rows=2).count() == 1
    (tmp_path / "kb.metta").write_text("(: a (P x) (STV 1 1))\n\n  \n(: b (P y) (STV 1 1))\n")
    assert files.statements(spark, str(tmp_path / "kb.metta"), "background").count() == 2
    (tmp_path / "r.jsonl").write_text('{"nl": "x", "pln": ["a"]}\n{"nl": "x"}\nbad\n\n')
    assert files.records(spark, str(tmp_path / "r.jsonl")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps([{"id": "one", "user_query": "Q?", "input_text": "T"}, {"name": "two", "question": "R?", "texts": ["a", "b"], "expected_proof": "yes"}]))
    rows = {r.name: r for r in files.cases(spark, str(tmp_path / "c.json")).collect()}
    assert rows["one"].texts == ["T"] and rows["one"].question == "Q?" and rows["two"].expected_proof is True
    assert files.pick_cases(files.cases(spark, str(tmp_path / "c.json")), "one").count() == 1
    (tmp_path / "m.json").write_text('{"source_file": "f", "min_weight": 2.0}')
    assert files.manifest(spark, str(tmp_path / "m.json"))["source_file"] == "f" and files.manifest(spark, str(tmp_path / "none.json")) is None
    assert files.is_stale(None, "f", 1, 2.0, 10.0, 42)
    lines = spark.createDataFrame([("b",), ("a",), ("a",)], "s string")
    assert files.lines_sha256(lines, "s") == files.lines_sha256(lines.repartition(3), "s") != files.lines_sha256(lines.distinct(), "s")
    files.write_manifest({"b": 1, "a": 2}, str(tmp_path / "w.json"))
    assert files.manifest(spark, str(tmp_path / "w.json")) == {"a": 2, "b": 1}
    assert files.needs_reindex(0, 0) and files.needs_reindex(3, 5) and not files.needs_reindex(5, 5) and not files.needs_reindex(1, 0)
    (tmp_path / "ctx.json").write_text('["(: a (P x) (STV 1 1))"]')
    assert files.context(spark, str(tmp_path / "ctx.json")).count() == 1


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/ingest_requests.parquet").repartition(2).write.parquet(str(src))

    def translate(batch):
        return batch.select(F.explode("texts").alias("t")).where("t is not null").select(F.concat(F.lit("(: n (Text x"), F.length("t").cast("string"), F.lit(") (STV 1 1))")).alias("stmt"))

    out = str(tmp_path / "out")
    ingest.ingest_stream(ingest.request_stream(spark, str(src)), translate, out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(f"{out}/statements")
    assert got.select("batch").distinct().count() == 2
    want = spark.read.parquet(str(src)).select(F.explode("texts").alias("t")).where("t is not null").count()
    assert got.count() == want
    assert ingest.vocabulary(got).first().head == "Text"


def test_query_says_how_many_answers_there_are(spark, tmp_path):
    t = ExternalTranslator(lambda chunks: [[] for _ in chunks], lambda q: "(: $prf (Said $x) $tv)")
    e = Engine(spark, str(tmp_path / "kb"), t)
    e.add(spark.createDataFrame([(f"(: n{i} (Said x{i:03}) (STV 1.0 1.0))",) for i in range(103)], "stmt string").repartition(4))
    got = e.query("?")
    assert got["answer_count"] == 103 and [r["$x"] for r in got["answers"]] == [f"x{i:03}" for i in range(100)]
    assert got["answer"].endswith("; and 3 more")
