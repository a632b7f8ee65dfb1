"""Registered queries of sources and sinks (written and read again), contexts, canonical forms and ingest counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import atoms, extract, hints, kb, metrics, planner, postprocess, reasoner, triples, vectors
from factloom.plans import relational
from factloom.plans.catalog import _ALIGNED, _NATION_SCORES, _extractions, _nation_goals, _nation_signatures, _statements, query
from factloom.plans.sqltext import EXTRACTIONS, FLAT, REASON, SCORE, STATEMENTS, TRIPLES, canon, normal, snake, words
from factloom.session import scratch_path, table
from factloom.sources import files
from factloom.streaming import ingest


# Sources and sinks: what is written to the shared folder is read again by the source under test.


@query(f"with {STATEMENTS} select source, count(*) as n, count(distinct stmt) as distinct_n from (select 'kb' as source, stmt from tidy where stmt <> '') group by 1")
def source_statements(spark, sf):
    """Statements as a text file of one a line, with blank lines between them."""
    path = scratch_path(spark, "lines")
    _statements(spark, sf).select(F.explode(F.array("stmt", F.lit(" "))).alias("value")).write.text(path)
    return files.statements(spark, path, "kb").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stmt").alias("distinct_n"))


@query("""
select coalesce(relation, '') as relation, count(*) as n, sum(case when start_uri like '/c/en/%' then 1 else 0 end)::bigint as english
from conceptnet_assertions group by 1
""")
def source_triples(spark, sf):
    """Raw triples as gzipped tab-separated lines, some of them cut off."""
    path = scratch_path(spark, "tsv") + ".gz"
    rows = table(spark, sf, "conceptnet_assertions").select(*[F.coalesce(c, F.lit("")).alias(c) for c in files.TRIPLE_COLUMNS])
    line = F.concat_ws("\t", *files.TRIPLE_COLUMNS)
    rows.select(F.explode(F.array(line, F.concat_ws("\t", "uri", "relation"))).alias("value")).write.option("compression", "gzip").text(path)
    return files.triples(spark, path).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start_uri").startswith("/c/en/").cast("long")).alias("english"))


@query("""
with r as (select case when json_valid(line) and json_type(line) = 'OBJECT' then line end as line from background_jsonl)
select json_extract_string(line, '$.source') as source, count(*) as n from r where json_extract_string(line, '$.nl') is not null and json_type(line, '$.pln') = 'ARRAY' group by 1
""")
def source_records(spark, sf):
    """Records as JSON lines; broken, blank and incomplete lines are skipped."""
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "background_jsonl").where(F.col("line").isNotNull()).select(F.translate("line", "\n\r", "  ").alias("value")).write.text(path)
    return files.records(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select name, category, question, len(texts) as n_texts, coalesce(expected_proof, null) as expected_proof from benchmark_cases")
def source_cases(spark, sf):
    """Benchmark cases in the other spelling: user_query, premises and words for truth values."""
    path = scratch_path(spark, "cases")
    c = table(spark, sf, "benchmark_cases")
    word = F.when(F.col("expected_proof"), F.element_at(F.array(*map(F.lit, ("yes", "1", "True", " y "))), (F.col("case_id") % 4 + 1).cast("int"))).when(~F.col("expected_proof"), F.lit("no"))
    c.select("name", F.col("question").alias("user_query"), F.col("texts").alias("premises"), F.coalesce("category", F.lit("~")).alias("category"), word.alias("expected_proof")).coalesce(1).write.json(path)
    rows = files.cases(spark, path, multi_line=False)
    return rows.select("name", F.nullif("category", F.lit("~")).alias("category"), "question", F.size("texts").cast("long").alias("n_texts"), "expected_proof")


@query(f"""
with {STATEMENTS}, v as (select stmt, {REASON} as reason from tidy where stmt <> '')
select case when contains(stmt, '(Implication') then 'rule' else 'statement' end as kind, count(*) as n, count(distinct stmt) as distinct_n from v where reason is null group by 1
""")
def kb_append(spark, sf):
    """Statements appended to a stored table, in two batches, and read again."""
    path = scratch_path(spark, "kb")
    rows = _statements(spark, sf)
    for part in (0, 1):
        kb.append(rows.where(F.col("record_id") % 2 == part).select("stmt"), path)
    stored = spark.read.parquet(path).withColumn("kind", F.when(F.col("kind") == "rule", "rule").otherwise("statement"))
    return stored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stmt").alias("distinct_n"))


@query(f"with {TRIPLES}, d as (select distinct predicate, source, target from eligible where {SCORE} < 0.5) select predicate as relation, count(*) as n_atoms, count(*) as n_records from d group by 1")
def background_files(spark, sf):
    """The export of the background triples, sampled, as a file of atoms and one of records, read again."""
    atoms_path, records_path = scratch_path(spark, "atoms"), scratch_path(spark, "records")
    rows = table(spark, sf, "conceptnet_assertions").withColumn("seq", F.col("assertion_id") * 1000 + F.col("load_batch"))
    files.write_background(triples.export(rows, 2.0, 50.0, 42), atoms_path, records_path)
    head = kb.parse_statements(files.statements(spark, atoms_path)).groupBy(F.col("head").alias("relation")).agg(F.count(F.lit(1)).alias("n_atoms"))
    return head.join(files.records(spark, records_path).groupBy("relation").agg(F.count(F.lit(1)).alias("n_records")), "relation")


@query("select manifest_id from conceptnet_manifest where normalization_version is distinct from 1 or min_weight is distinct from 2.0 or coverage_percent is distinct from 10.0 or sample_seed is distinct from 42")
def stale_exports(spark, sf):
    """Exports that were made with other settings than those at hand."""
    return table(spark, sf, "conceptnet_manifest").where(files.stale(version=1, min_weight=2.0, coverage=10.0, seed=42)).select("manifest_id")


@query("select case_id from benchmark_cases where name in (select name from benchmark_cases where case_id in (3, 77, 200))")
def picked_cases(spark, sf):
    c = table(spark, sf, "benchmark_cases")
    names = [r.name for r in c.where(F.col("case_id").isin(3, 77, 200)).select("name").collect()]  # three names
    return files.pick_cases(c.withColumn("id", F.lit(None).cast("string")), names).select("case_id")


# Contexts.


@query("""
with q as (select q.vec_id as query_id, p.vec_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 12) as score from (select * from embeddings where vec_id % 100 = 0) q, embeddings p),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from q)
select query_id, flatten(list(['a' || vec_id, 'b' || vec_id] order by k)) as context from r where k <= 5 group by 1
""")
def retrieved_context(spark, sf):
    """The statements of the five points nearest to each query, in order of rank."""
    e = table(spark, sf, "embeddings")
    ranked = vectors.top_k(e, e.where(F.col("vec_id") % 100 == 0), 5)
    i = F.col("vec_id").cast("string")
    points = e.select("vec_id", F.array(F.concat(F.lit("a"), i), F.concat(F.lit("b"), i)).alias("pln"))
    return vectors.context(ranked, points, "vec_id")


@query("""
with f as (select case when background then 1 else 0 end as part, record_id, unnest(pln) as stmt from vector_records),
d as (select stmt, min({'part': part, 'r': record_id}) as place from f group by 1)
select stmt, place.part as part, place.r as record_id from d order by place desc, stmt desc limit 50
""")
def context_enriched(spark, sf):
    """Own statements first, retrieved ones behind them, each at its first place; the last 50."""
    rows = table(spark, sf, "vector_records").select(F.explode("pln").alias("stmt"), F.struct(F.when(F.col("background"), 1).otherwise(0).alias("part"), F.col("record_id")).alias("at"))
    return vectors.last_distinct(rows, "stmt", "at", 50).select("stmt", "at.part", "at.record_id")


# Canonical forms.

_PIECES = "regexp_extract_all(stmt, '[$?\\p{L}_][\\p{L}\\p{N}_]*|[^$?\\p{L}_]+')"
_HEADS = ", ".join(f"'{h}'" for h in atoms.STRUCTURAL_HEADS)
_ALIASES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in atoms.PREDICATE_ALIASES.items()) + "}"


@query(f"""
with {STATEMENTS}, p as (select record_id, pos, {_PIECES} as l from tidy),
h as (select record_id, pos, array_to_string([case when not regexp_matches(l[i], '^[$?\\p{{L}}_]') then l[i] when l[i][1] in ('$', '?') then l[i][1] || {canon('l[i][2:]', False)}
  when i > 1 and regexp_matches(l[i - 1], '\\(\\s*$') then case when l[i] in ({_HEADS}) then l[i] else coalesce({_ALIASES}[{canon('l[i]', False)}], l[i]) end
  else {canon('l[i]')} end for i in range(1, len(l) + 1)], '') as stmt from p)
select record_id, cast(pos as int) as pos, stmt as canonical from h
""")
def canonical_statements(spark, sf):
    """Every identifier of the stored statements in canonical form, heads by alias, without names of a text."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    made = postprocess.canonical_statement(F.col("stmt"), none, none, none, F.array().cast("array<string>"))
    return _statements(spark, sf).select("record_id", "pos", made.alias("canonical"))


@query(f"""
with {STATEMENTS}, h as (select record_id, pos, regexp_extract_all(stmt, '\\(([A-Za-z][A-Za-z0-9_]*)', 1) as l from tidy)
select record_id, cast(pos as int) as pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i and x not in ('Implication', 'Premises', 'Conclusions', 'STV', 'And', 'Or', 'Not', 'IsA')), ' ') as heads from h
""")
def context_heads(spark, sf):
    return _statements(spark, sf).select("record_id", "pos", F.array_join(atoms.context_heads(F.array("stmt")), " ").alias("heads"))


@query(f"""
with w as (select case_id, question, regexp_extract(question, '^\\s*(\\S+)', 1) as first, list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_-]+'), lambda t: regexp_matches(t, '^[A-Z][A-Za-z0-9_-]*$')) as l from benchmark_cases),
c as (select case_id, [{canon('t', False)} for t in l if not (t = first and regexp_matches(t[2:], '[a-z]') and lower(t[2:]) = t[2:])] as l from w)
select case_id, list_filter(l, lambda x, i: x <> '' and list_position(l, x) = i) as constants from c
""")
def protected_constants(spark, sf):
    return table(spark, sf, "benchmark_cases").select("case_id", text.protected_constants(F.col("question")).alias("constants"))


@query(f"""
select p_partkey, replace({snake('p_name')}, '_', '-') as kebab, regexp_replace(regexp_replace(trim(upper(p_name)), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as kept,
  coalesce(nullif(trim(case when p_partkey % 2 = 0 then p_name else ' ' end), ''), p_brand) as first, p_type as model from part
""")
def symbol_variants(spark, sf):
    n = F.col("p_name")
    first = text.first_nonempty(F.when(F.col("p_partkey") % 2 == 0, n).otherwise(" "), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", text.kebab_symbol(n).alias("kebab"), text.snake_symbol(F.upper(n), preserve_case=True).alias("kept"), first.alias("first"), text.model_name(F.concat(F.lit("maker/"), "p_type")).alias("model"))


# Goals.


@query(_ALIGNED + f""", own as (select question, 0 as stage, score, goal_id as seq, goal from ({_NATION_SCORES})),
aligned as (select 'Is nation_' || goal_id // 10 || ' part of a region?' as question, 1 as stage, points[1] + points[2] as score, goal_id as seq, '(: $prf (PartOf ' || a[1] || ' ' || a[2] || ') $tv)' as goal from p where points[1] is not null and points[2] is not null),
every as (select * from own union all select * from aligned), b as (select question, goal, min({{'stage': stage, 'minus': -score, 'seq': seq}}) as b from every group by 1, 2),
k as (select question, goal, row_number() over (partition by question order by b.stage, b.minus, b.seq, goal) as rank from b)
select question, goal, rank from k where rank <= 5
""")
def capped_candidates(spark, sf):
    """The first five candidates of each question."""
    return planner.cap_candidates(planner.plan(_nation_goals(spark, sf), _nation_signatures(spark, sf)), 5).select("question", "goal", "rank")


@query("""
select n_nationkey * 10 + k as goal_id, m as other, (r = '$r' or r = 'region_' || mr) and n_nationkey = m as kept
from nation, (values (0, '$r'), (1, 'region_0'), (2, 'region_3')) v(k, r), (select n_nationkey as m, n_regionkey as mr from nation where n_nationkey % 5 = 0) o
where n_nationkey % 5 = 0
""")
def preserved_arguments(spark, sf):
    """Which signatures of every fifth nation keep the constants of goals of every fifth nation."""
    g = _nation_goals(spark, sf).withColumn("sig", atoms.parse_flat(atoms.goal_atom(F.col("goal")))).where((F.floor(F.col("goal_id") / 10) % 5) == 0)
    o = relational.nations(spark, sf).select(F.col("args").alias("other_args"), F.regexp_extract(F.get("args", F.lit(0)), r"(\d+)$", 1).cast("int").alias("other")).where("other % 5 = 0")
    met = g.withColumn("one", F.lit(1)).join(F.broadcast(o.withColumn("one", F.lit(1))), "one")  # five rows
    symbols = text.question_constants(F.col("question"))
    return met.select("goal_id", "other", planner.preserves_grounded(F.col("sig.args"), F.col("other_args"), symbols).alias("kept"))


@query(f"""
with {EXTRACTIONS[EXTRACTIONS.index("with ") + 5 : EXTRACTIONS.rindex("select assertion_id, load_batch")]}
select assertion_id, load_batch, case when why is null then '(: $prf ' || case when cls = 'negation' then '(Not ' || atom || ')' else atom end || ' $tv)' end as goal, why as reason from (
  select *, case when cls = 'guess' then 'unsupported query class ''guess''' when cls in ('fact', 'negation') and pred is null then 'missing required attribute ''predicate'''
    when cls = 'type_decl' and sub is null then 'missing required attribute ''entity''' when cls = 'type_decl' and obj is null then 'missing required attribute ''type'''
    when cls = 'property' and sub is null then 'missing required attribute ''entity''' when cls = 'property' and obj is null then 'missing required attribute ''value'''
    when cls = 'inheritance' and sub is null then 'missing required attribute ''child''' when cls = 'inheritance' and obj is null then 'missing required attribute ''parent'''
    when cls in ('fact', 'negation') and sub is null and obj is null then 'fact requires at least one argument' end as why from n)
""")
def extraction_goals(spark, sf):
    return extract.goals(_extractions(spark, sf)).select("assertion_id", "load_batch", "goal", "reason")


@query("""
with a as (select item_id, atoms as x, pln as y from ingest_item_results join (select item_id, min_by(pln, record_id) as pln from vector_records where item_id is not null group by 1) using (item_id)),
m as (select item_id, list_concat(coalesce(x, []), coalesce(y, [])) as l from a)
select item_id, list_filter(l, lambda v, i: list_position(l, v) = i) as merged from m
""")
def merged_statements(spark, sf):
    """Statements of an item and of its record, each once, in order."""
    r = table(spark, sf, "vector_records").where("item_id is not null").groupBy("item_id").agg(F.min_by("pln", "record_id").alias("pln"))
    rows = table(spark, sf, "ingest_item_results").select("item_id", "atoms").join(r, "item_id")
    return rows.select("item_id", planner.merge_ordered(F.col("atoms"), F.col("pln")).alias("merged"))


# Rules.


@query("""
select 'nation_' || a.n_nationkey as a, 'nation_' || b.n_nationkey as b from nation a join nation b using (n_regionkey) where a.n_nationkey <> b.n_nationkey and a.n_regionkey < 2
""")
def different_premise(spark, sf):
    """Neighbours: two nations of a region that are stated to differ. Difference is a fact like any other."""
    n = table(spark, sf, "nation").where("n_regionkey < 2").select("n_nationkey")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.lit(1).alias("one")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.lit(1).alias("one"))), "one").where("a <> b")  # ten nations
    facts = relational.nations(spark, sf).unionByName(relational.fact(pairs, "Different", relational.named("nation", "a"), relational.named("nation", "b")))
    rule = "(: near (Implication (Premises (PartOf $a $r) (PartOf $b $r) (Different $a $b)) (Conclusions (Near $a $b))) (STV 1.0 1.0))"
    out = reasoner.fixpoint(facts, reasoner.parse_rule(rule)).where("head = 'Near'")
    return out.select(F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"))


@query("""
select 'supplier_' || s_suppkey as who, round(0.9 * 0.5, 6) as confidence from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2) and s_acctbal > 5000
""")
def computed_premise(spark, sf):
    """Suppliers of a region whose doubled balance is over a bound, by premises that compute and compare, a premise that
    shares no variable with its neighbour in the text, and a ground one."""
    s = table(spark, sf, "supplier")
    who = relational.named("supplier", "s_suppkey")
    held = relational.fact(s, "Balance", who, F.col("s_acctbal").cast("string"))
    switch = spark.range(1).select(F.lit("Open").alias("head"), F.array(F.lit("market")).alias("args"), F.lit(1.0).alias("s"), F.lit(0.5).alias("c"))
    base = relational.locations(spark, sf).unionByName(relational.nations(spark, sf)).unionByName(held).unionByName(switch)
    rule = "(: rich (Implication (Premises (PartOf $n region_2) (Balance $x $b) (AtLocation $x $n) (Open market) (Compute * ($b 2) -> $d) (GreaterThan $d 10000)) (Conclusions (Rich $x))) (STV 1.0 0.9))"
    out = reasoner.apply_rules(base.withColumn("dist", F.lit(None).cast("array<struct<x:double,w:double>>")), reasoner.parse_rule(rule))
    return out.select(F.get("args", F.lit(0)).alias("who"), F.round("c", 6).alias("confidence"))


# Ingest.


@query(f"""
with i as (select distinct item_id, text, atoms from ingest_item_results where text is not null and trim(text) <> ''), a as (select item_id, unnest(atoms) as raw from i),
v0 as (select item_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as stmt from a), v as (select item_id, stmt, {REASON} as reason from v0 where stmt <> ''),
c as (select item_id, count(*) filter (reason is null) as n_atoms, count(*) filter (reason is not null) as rejected_count, list(stmt order by stmt, reason) filter (reason is not null) as bad from v group by 1)
select item_id, 1::bigint as chunk_count, coalesce(n_atoms, 0) as n_atoms, coalesce(rejected_count, 0) as rejected_count, coalesce(bad[1:3], []) as rejected_samples, case when coalesce(n_atoms, 0) = 0 then 'failed' else 'success' end as status
from i left join c using (item_id)
""")
def item_counters(spark, sf):
    """Counters, first three rejected statements and status of every item, each taken as one chunk."""
    i = table(spark, sf, "ingest_item_results").where(F.trim("text") != "").select("item_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"), "atoms").distinct()
    checked = atoms.validate(i.select("item_id", "chunk_no", F.explode("atoms").alias("stmt")))
    return metrics.ingest_counters(i.drop("atoms"), checked, "item_id").select("item_id", "chunk_count", "n_atoms", "rejected_count", "rejected_samples", "status")


@query(f"""
with {STATEMENTS}, b as (select regexp_extract(stmt, '^\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\(', 1) as body from tidy)
select regexp_extract(body, '^{FLAT}$', 1) as head, cast(len(list_filter(string_split_regex(trim(regexp_extract(body, '^{FLAT}$', 2)), '\\s+'), lambda x: x <> '')) as int) as arity, count(*) as uses
from b where regexp_matches(body, '^{FLAT}$') group by 1, 2
""")
def predicate_vocabulary(spark, sf):
    facts = kb.parse_statements(_statements(spark, sf)).where(~F.col("head").startswith("Not:"))
    return ingest.vocabulary(facts)


@query("select event_id, lower(trim(f)) in ('1', 'true', 'yes', 'y') as truthy, p <> '' and p <> '[]' as proved from (select event_id, case event_id % 6 when 0 then ' Yes' when 1 then '1' when 2 then 'no' when 3 then 'TRUE' when 4 then '' else 'y' end as f, case event_id % 3 when 0 then '[]' when 1 then '' else 'x' end as p from events)")
def flags(spark, sf):
    i = F.col("event_id")
    f = F.when(i % 6 == 0, " Yes").when(i % 6 == 1, "1").when(i % 6 == 2, "no").when(i % 6 == 3, "TRUE").when(i % 6 == 4, "").otherwise("y")
    p = F.when(i % 3 == 0, "[]").when(i % 3 == 1, "").otherwise("x")
    return table(spark, sf, "events").select("event_id", metrics.truthy(f).alias("truthy"), metrics.proof_found(p).alias("proved"))


@query("select (select count(*) from vector_records where background) as background, (select count(*) from vector_records where not background) as own, (select count(*) from vector_records where source is null) as without_source")
def kb_sizes(spark, sf):
    """Numbers of records by kind, in one pass."""
    b = F.col("background")
    return table(spark, sf, "vector_records").agg(F.count_if(b).alias("background"), F.count_if(~b).alias("own"), F.count_if(F.col("source").isNull()).alias("without_source"))


@query("""
with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), p as (select vec_id, embedding, 'sentence ' || label as nl from embeddings where vec_id % 50 <> 0),
s as (select q.vec_id as proof_id, p.nl, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 12) as score, p.vec_id from q, p),
r as (select *, row_number() over (partition by proof_id order by score desc, vec_id) as k from s)
select proof_id, nl from r where k = 1 and score > 0.2
""")
def source_nearest(spark, sf):
    """The sentence nearest to the atom of a proof, with vectors that the atoms spell out."""
    e = table(spark, sf, "embeddings")
    atom = F.concat(F.lit("(at "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "), F.lit(")"))
    proofs = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("proof_id"), F.concat(F.lit("("), atom, F.lit(" (STV 1.0 1.0))")).alias("proof"))
    points = e.where(F.col("vec_id") % 50 != 0).select("vec_id", "embedding", F.concat(F.lit("sentence "), F.col("label").cast("string")).alias("nl"))
    spelled = lambda text_: F.transform(F.slice(F.split(text_, " "), 2, 64), lambda x: x.cast("float"))
    return vectors.source_lookup(proofs, points, spelled, least=0.2)


@query(f"""
with n as (select case_id, question, string_split({normal('question')}, ' ') as w, {normal('question')} as q, texts from benchmark_cases)
select case_id, case when q = '' then [] else list_filter([
  case when w[1] in ({words(text.YES_NO_WORDS)}) then '; intent: yes-no question, prefer a goal that can be proved directly' when list_has_any(w, [{words(hints.QUESTION_WORDS)}]) then '; intent: open question, prefer a goal with a variable' end,
  case when list_has_any(w, [{words(hints.EXISTENTIAL_WORDS)}]) then '; existential wording: a helper predicate is allowed where no direct goal can be derived' end,
  case when list_has_any(w, ['not', 'never']) then '; negation only where facts or rules state it' end,
  '; predicates to use first: IsA, STV, PartOf',
  case when ends_with(question, '?') then '; keep what the question asks and a goal that can be run' end], lambda x: x is not null) end as lines from n where question is not null
""")
def question_hints(spark, sf):
    """What a translator is told of each question, in a context of two statements."""
    known = F.lit("(: a (IsA x y) (STV 1 1)) (: b (PartOf x y) (STV 1 1))")
    q = table(spark, sf, "benchmark_cases").where("question is not null")
    return q.select("case_id", hints.question_hints(F.col("question"), known, full=True).alias("lines"))


@query(f"""
with {STATEMENTS}, h as (select record_id, pos, regexp_extract_all(stmt, '\\(([A-Za-z][A-Za-z0-9_]*)', 1) as l from tidy),
d as (select record_id, pos, list_filter(l, lambda x, i: list_position(l, x) = i and x not in ('Implication', 'Premises', 'Conclusions', 'STV', 'And', 'Or', 'Not', 'IsA')) as l from h),
k as (select record_id, pos, ['known-one'] || list_filter(l, lambda x: x <> 'known-one') as l from d)
select record_id, cast(pos as int) as pos, array_to_string([x || '->' || replace({snake('x')}, '_', '-') for x in l[1:24]], ', ') as pairs from k
""")
def vocabulary_pairs(spark, sf):
    pairs = extract.vocabulary_pairs(F.array(F.lit("known-one")), F.array("stmt"))
    return _statements(spark, sf).select("record_id", "pos", pairs.alias("pairs"))
