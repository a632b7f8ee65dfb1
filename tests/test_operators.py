import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import dist, text
from factloom.operators import chunk, extract, metrics, planner, triples, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("word,want", [("dogs", "dog"), ("cities", "city"), ("buses", "bus"), ("glass", "glass"), ("bus", "bus"), ("is", "is"), ("", ""), (None, None)])
def test_singular(spark, word, want):
    assert one(spark, word, text.singularize) == want


@pytest.mark.parametrize("token,want", [("RedDogs", "red_dog"), (" big-cats ", "big_cat"), ("a  b!!c", "a_b_c"), ("", ""), ("é", ""), (None, None)])
def test_canonical(spark, token, want):
    assert one(spark, token, text.canonical_symbol) == want


def test_units_and_batches(spark):
    t = "Dogs bark. They run. However they sleep. Cats purr! This finding holds. It, though."
    assert one(spark, t, chunk.sentence_units) == ["Dogs bark. They run. However they sleep.", "Cats purr! This finding holds.", "It, though."]
    assert one(spark, "It runs.", chunk.sentence_units) == ["It runs."]
    assert one(spark, "", chunk.sentence_units) == [] and one(spark, None, chunk.sentence_units) is None
    assert one(spark, ["aa", "bb", "cc"], lambda c: chunk.batches(c, 2, 100), "array<string>") == [["aa", "bb"], ["cc"]]
    assert one(spark, ["aa", "bb", "cc"], lambda c: chunk.batches(c, 9, 5), "array<string>") == [["aa", "bb"], ["cc"]]
    assert one(spark, [], chunk.batches, "array<string>") == []


def test_windows():
    t = "".join(f"Sentence {i} is here. " for i in range(200))
    parts = chunk.windows(t, 100, 10)
    assert max(map(len, parts)) <= 100 and all(p.endswith(".") for p in parts)
    assert chunk.windows("x" * 513, 512, 64)[0] == "x" * 512 and chunk.windows("", 10, 2) == []
    with pytest.raises(ValueError):
        chunk.windows("x" * 99, 10, 10)
    assert chunk.paragraph_chunks("a\n\nb\n\n" + "c" * 5, 5) == ["a\n\nb", "ccccc"]


def test_paragraphs_follow_the_rule():
    """Against the rule step by step: groups are measured with a joint behind each part, a later sentence group without."""
    text = "Aa bb. It cc. His dd. Ee ff gg. As a result hh. " * 3 + "\n\n" + "x" * 12 + "\n \n" + "y" * 9 + "\n\n" + "z" * 40
    got = chunk.paragraph_chunks(text, 30)
    assert got[:2] == ["Aa bb. It cc. His dd.", "Ee ff gg. As a result hh."] and got[-2:] == ["x" * 12 + "\n\n" + "y" * 9, "z" * 40]
    assert chunk.paragraph_chunks(" \n ", 5) == [] and chunk.paragraph_chunks(" ab ", 5) == ["ab"]


def test_alignment(spark):
    q = spark.createDataFrame([(1, "Is the tail located in an old barn?", "(: $prf (Near big_tail barns) $tv)")], "goal_id int, question string, goal string")
    sig = spark.createDataFrame([("AtLocation", ["big_tail", "barn"], "fact"), ("AtLocation", ["very_big_tail", "old_shed"], "fact"), ("AtLocation", ["cat", "barn"], "fact"), ("AtLocation", ["x", "y", "z"], "fact"), ("Near", ["big_tail", "barns"], "fact")], "head string, args array<string>, kind string")
    got = {(r.candidate, r.score) for r in planner.aligned_fallback(q, sig).collect()}
    assert got == {("(: $prf (AtLocation big_tail barn) $tv)", 10), ("(: $prf (AtLocation very_big_tail old_shed) $tv)", 6)}
    open_ = spark.createDataFrame([(1, "Is Rex here?", "(: $prf (At $x home) $tv)"), (2, "Is it?", "(: $prf (At $x $y) $tv)")], "goal_id int, question string, goal string")
    facts = spark.createDataFrame([("At", ["rex", "home"], "fact"), ("At", ["tom", "home"], "conclusion"), ("At", ["tom", "town"], "fact"), ("At", ["$p", "home"], "conclusion")], "head string, args array<string>, kind string")
    got = {(r.goal_id, r.candidate, r.score) for r in planner.grounded_fallback(open_, facts).collect()}
    at = "(: $prf (At {}) $tv)".format
    assert got == {(1, at("rex home"), 8), (1, at("tom home"), 2), (2, at("rex home"), 3), (2, at("tom home"), 2), (2, at("tom town"), 3)}
    lost = planner.retry_goals(spark.createDataFrame([("q", 1), ("q", 2)], "question string, rank int"), 4, 5)
    assert [r["rank"] for r in lost.collect()] == [1]


def test_triples(spark):
    rows = [
        (1, 0, "f", "/r/IsA", "/c/en/Dogs/n", "/c/en/animal", '{"weight": 2.0}'), (2, 0, "f", "/r/HasProperty", "/c/en/dog", "/c/en/animal", '{"weight": "3"}'),
        (3, 0, "f", "/r/Synonym", "/c/en/dog", "/c/en/hound", "{}"), (4, 0, "f", "/r/IsA", "/c/de/hund", "/c/en/animal", "{}"), (5, 0, "f", "/r/IsA", None, "/c/en/animal", "{}"),
        (6, 0, "f", "/r/IsA", "/c/en/cat", "/c/en/animal", "{bad"), (7, 0, "f", "/r/IsA", "/c/en/cat", "/c/en/animal", '{"weight": null}'), (8, 0, "f", "/r/IsA", "/c/en/cat", "/c/en/animal", '{"weight": "x"}'),
        (9, 0, "f", "/r/IsA", "/c/en/cat", "/c/en/animal", "{}"), (10, 0, "f", "/r/IsA", "/c/en/__", "/c/en/animal", "{}"), (11, 0, "f", "/r/IsA", "/c/en/cat", "/c/en/animal", None),
    ]
    df = spark.createDataFrame(rows, "assertion_id long, load_batch int, source_file string, relation string, start_uri string, end_uri string, metadata_json string")
    assert {r.assertion_id for r in triples.eligible(df, 1.0).collect()} == {1, 2, 9}
    first = triples.dedupe_first(triples.eligible(df, 1.0).withColumn("seq", F.col("assertion_id")))
    out = {r.nl: r.atom for r in triples.emit(first).collect()}
    assert set(out) == {"dog is a kind of animal", "cat is a kind of animal"} and out["dog is a kind of animal"].endswith("(IsA dog animal) (STV 1.0 0.9091))")
    m = triples.manifest(df, 1.0, 100.0, 42).first()
    assert (m.scanned_rows, m.eligible_row_count, m.sampled_row_count, m.deduped_atom_count) == (11, 3, 3, 2)
    half, more = ({tuple(r) for r in triples.hash_sample(triples.eligible(df, 1.0), p).select("source", "target").collect()} for p in (40.0, 80.0))
    assert half <= more
    with pytest.raises(ValueError):
        triples.hash_sample(df, 0)


def test_distributions(spark):
    row = spark.range(1).select(dist.from_pairs(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(3.0))).alias("a"), dist.from_normal(F.lit(10.0), F.lit(2.0)).alias("n"))
    got = row.select(
        dist.mean("a").alias("m"), dist.greater_than(F.col("a"), F.lit(2.0)).alias("g"), F.round(dist.mean("n"), 6).alias("nm"), dist.greater_than_dist(F.col("n"), F.col("a")).alias("gg"),
        dist.mean(dist.map2_dist(F.col("a"), F.col("a"), lambda x, y: x * y)).alias("xy"), F.size(dist.reduced(dist.map2_dist(F.col("n"), F.col("n"), lambda x, y: x + y))).alias("k"),
        F.round(dist.mean(dist.reduced(dist.map2_dist(F.col("n"), F.col("n"), lambda x, y: x + y))), 6).alias("km"), dist.mean(dist.map_dist(F.col("a"), lambda x: x + 1)).alias("p"),
    ).first()
    assert tuple(got) == (2.5, 0.75, 10.0, 1.0, 6.25, 64, 20.0, 3.5)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_VALUES", 20)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = vectors.top_k(df, df.where("vec_id < 6"), 5).collect()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for q in range(6):
        s = np.round(u @ u[q], 12)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert vectors.top_k(df.limit(0), df, 3).count() == 0 and vectors.top_k(df, df.limit(0), 3).count() == 0


def test_planner(spark):
    q = spark.createDataFrame([(1, "Is a hammer used for nails?"), (2, "Who is smart?"), (3, None), (4, "Is the wheel part of a car?")], "i int, q string")
    got = {r.i: r.g for r in q.select("i", planner.question_goal(F.col("q")).alias("g")).collect()}
    assert got == {1: "(: $prf (UsedFor hammer nail) $tv)", 2: None, 3: None, 4: "(: $prf (PartOf wheel car) $tv)"}
    goals = spark.createDataFrame([(1, "Is rex a dog?", "(: $prf (IsA rex dog) $tv)"), (2, "Is rex a dog?", "(: $prf (IsA $x cat) $tv)"), (3, "Who?", "(: $prf (IsA $x dog) $tv)"), (4, "Who?", "broken"), (5, "Is it?", "(: $prf (Q $x) $tv)")], "goal_id int, question string, goal string")
    sig = spark.createDataFrame([("IsA", ["rex", "dog"], "fact"), ("IsA", ["$p", "pet"], "conclusion")], "head string, args array<string>, kind string")
    scored = planner.score_goals(goals, sig)
    assert {r.goal_id: r.score for r in scored.collect()} == {1: 15, 2: None, 3: 13, 5: None}
    ranked = {(r.question, r.goal_id): r["rank"] for r in planner.rank_goals(scored).collect()}
    assert ranked == {("Is rex a dog?", 1): 1, ("Who?", 3): 1, ("Is it?", 5): 1}


def test_extractions(spark):
    rows = [
        ("fact", {"predicate": "works for", "subject": "Ana Bell", "object": "Lo Works"}, [], None), ("type_decl", {"entity": "rex", "type": "Dogs"}, [], "MATCH_EXACT"),
        ("property", {"entity": "rex", "property": "color", "value": "red"}, [], "MATCH_FUZZY"), ("rule", {"head_predicate": "smart", "head_args": "$p", "body": "(match &self (and (eats $p Fishes) (isa $p human) (not (sad $p))) $p)"}, [], None),
        ("rule", {"head_predicate": "smart", "body": "(and (eats"}, [], None), ("fact", {"subject": "x"}, [], None), ("negation", {"predicate": "isa", "subject": "$x", "object": "b"}, [], None), ("other", {}, [], None), (None, {}, [], None),
        ("negation", {"predicate": "isa", "subject": "tom", "object": "dog"}, [], None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cls string, attributes map<string,string>, arguments array<string>, alignment string")
    got = {r.i: (r.stmt, r.reason) for r in extract.translate(df).collect()}
    assert got[0][0].endswith("(WorksFor ana_bell lo_work) (STV 1.0 1.0))") and got[1][0].endswith("(IsA rex dog) (STV 1.0 1.0))")
    assert got[0][0].startswith("(: ana_bell_lo_work_works_for_fact ") and got[1][0].startswith("(: rex_dog_isa_type ")
    assert got[3][0] == "(: p_smart_rule (Implication (Premises (Eats $p fishe) (IsA $p human) (Not (Sad $p))) (Conclusions (Smart $p))) (STV 1.0 1.0))"
    assert [got[i][1] for i in (2, 4, 5, 6, 7, 8)] == ["fuzzy alignment", "rule body unparseable", "missing required attribute 'predicate'", "free variable in 'subject' for negation", "unsupported statement class 'other'", "unsupported statement class ''"]
    assert "(Not (IsA tom dog))" in got[9][0]
    asked = {r.i: (r.goal, r.reason) for r in extract.goals(df).collect()}
    assert asked[2][0] == "(: $prf (Has rex color red) $tv)" and asked[3][1] == "query cannot target a rule" and asked[6][0] == "(: $prf (Not (IsA $x b)) $tv)"
    names = spark.createDataFrame([("We saw Rabies and James. Physics is hard. James left with physics.",)], "t string").select(extract.proper_spellings(F.col("t")).alias("m")).first().m
    assert names == {"rabies": "Rabies", "james": "James"}
    assert one(spark, "James", lambda c: extract.value(c, F.create_map(F.lit("james"), F.lit("James")))) == "james" and one(spark, "rabies", extract.value) == "rabies"
    assert one(spark, "James", extract.value) == "jame" and one(spark, "$Big Dog", extract.value) == "$Big_Dog" and one(spark, "T-cells x9s", extract.value) == "t_cells_x9s"
    assert {r.head for r in extract.predicate_heads(df, "i").collect()} == {"works-for", "smart", "isa"}
    pairs = spark.createDataFrame([(["is-a"], ["(: a (PartOf x y) (STV 1 1))"])], "h array<string>, c array<string>").select(extract.vocabulary_pairs(F.col("h"), F.col("c")).alias("v")).first().v
    assert pairs == "is-a->is-a, PartOf->part-of"
    for bad in ("", "(a", "(a) b", "a b"):
        with pytest.raises(ValueError):
            extract.parse_expression(bad)


def test_metrics(spark):
    df = spark.createDataFrame([("p", True, True, "well_aligned", False, 1.0, None, 4.0, "(: $prf (P a) $tv)", "(: $prf (P a) $tv)"), ("p", False, None, "no_query", True, 3.0, 2.0, None, None, None)], "parser string, proof_found boolean, expected boolean, status string, fallback_used boolean, seconds double, ingest_seconds double, query_seconds double, original_query string, executed_query string")
    r = metrics.parser_summary(df).first()
    assert (r.cases, r.correct, r.correct_known, r.proof_found, r.no_query, r.median_seconds) == (2, 1, 1, 1, 1, 2.0)
    a = metrics.analysis_summary(df).first()
    assert (a.proof_rate, a.proxy_rate, a.unparsed_heads, a.median_ingest_plus_query) == (0.5, 0.0, 0, 3.0)
    assert metrics.parser_summary(df.limit(0)).count() == 0
    assert one(spark, "(: $prf (Not (P a)) $tv)", metrics.goal_head) == "P" and one(spark, "x", metrics.goal_head) == "__unparsed__"
