"""Registered queries of the engine's own operators, each with the DuckDB statement of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dist, text
from factloom.operators import atoms, chunk, closure, extract, hints, kb, metrics, planner, reasoner, triples, vectors
from factloom.plans import relational
from factloom.plans.sqltext import BATCHES, CHUNKS, CONCEPTS, EXTRACTIONS, FLAT, PARAGRAPHS, REASON, SCORE, SENTENCES, STATEMENTS, TRIPLES, UNITS, YES_NO, canon, normal, normal_particles, plural, singular
from factloom.session import table
from factloom.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Who is at region_1: suppliers and customers by the two-premise location rule."""
    return _QUERIES["rule_join_two_premise"](spark, sf)


# Text.


@query(f"select doc_id, {normal('text')} as norm from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("""
with w as (select distinct unnest(string_split(lower(p_name), ' ')) as word from part), v as (select word, {p} as plural0 from w)
select word, plural0 as plural, {s} as back from v
""".format(p=plural("word"), s=singular("plural0")))
def pluralize_roundtrip(spark, sf):
    w = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return w.withColumn("plural", text.pluralize(F.col("word"))).withColumn("back", text.singularize(F.col("plural")))


@query(f"""
select assertion_id, {canon("coalesce(regexp_extract(start_uri, '^/c/[a-z]+/([^/]*)', 1), '')")} as symbol,
  {canon("coalesce(regexp_extract(start_uri, '^/c/[a-z]+/([^/]*)', 1), '')", False)} as plain from conceptnet_assertions
""")
def canonical_symbols(spark, sf):
    term = F.coalesce(F.regexp_extract("start_uri", "^/c/[a-z]+/([^/]*)", 1), F.lit(""))
    return table(spark, sf, "conceptnet_assertions").select("assertion_id", text.canonical_symbol(term).alias("symbol"), text.canonical_symbol(term, False).alias("plain"))


@query(f"with {SENTENCES} select doc_id, cast(pos as int) as pos, sentence from sentences")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(UNITS)
def sentence_units(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.sentence_units(F.col("text"))).alias("unit_no", "unit"))


@query(CHUNKS)
def document_chunks(spark, sf):
    return chunk.document_chunks(table(spark, sf, "documents"))


@query(PARAGRAPHS)
def paragraph_chunks(spark, sf):
    return chunk.document_paragraphs(table(spark, sf, "documents"))


@query(BATCHES)
def chunk_batches(spark, sf):
    units = chunk.sentence_units(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.batches(units)).alias("batch_no", "batch"))


@query(CONCEPTS)
def extract_concepts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.extract_concepts(F.col("text")).alias("concepts"))


@query(f"select case_id, coalesce({YES_NO}, false) as yes_no from benchmark_cases")
def yes_no_questions(spark, sf):
    return table(spark, sf, "benchmark_cases").select("case_id", F.coalesce(text.is_yes_no(F.col("question")), F.lit(False)).alias("yes_no"))


@query(r"""
select p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as snake,
  replace(replace(lower(p_name), ' ', '_'), '-', '_') as slug,
  array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split_regex(p_name, '[^A-Za-z0-9]+') if x <> ''], '') as pascal
from part
""")
def symbol_styles(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", text.snake_symbol(n).alias("snake"), text.slug(n).alias("slug"), text.pascal_symbol(n).alias("pascal"))


_INNER = "flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: string_split_regex(x, '\\s+')[2:]))"


@query(f"""
with w as (select doc_id, list_filter(list_transform({_INNER}, lambda x: regexp_extract(x, '[A-Za-z][A-Za-z0-9_]*', 0)), lambda x: x <> '') as l from documents)
select doc_id, list_sort(list_distinct(list_filter([lower(x) for x in l if regexp_matches(x, '^[A-Z]')], lambda y: not list_contains(l, y)))) as names from w
""")
def proper_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hints.proper_names(F.col("text")).alias("names"))


# Statements.


def _statements(spark, sf):
    rows = table(spark, sf, "vector_records").select("record_id", F.posexplode("pln").alias("pos", "stmt"))
    return rows.withColumn("stmt", atoms.collapse_space(F.col("stmt")))


@query(f"with {STATEMENTS} select record_id, cast(pos as int) as pos, {REASON} as reason from tidy where stmt <> ''")
def statement_validate(spark, sf):
    return atoms.validate(_statements(spark, sf)).select("record_id", "pos", "reason")


@query(f"""
with {STATEMENTS}, b as (select stmt, regexp_extract(stmt, '^\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\(', 1) as body from tidy)
select regexp_extract(body, '^{FLAT}$', 1) as head, cast(len(list_filter(string_split_regex(trim(regexp_extract(body, '^{FLAT}$', 2)), '\\s+'), lambda x: x <> '')) as int) as arity, count(*) as n
from b where regexp_matches(body, '^{FLAT}$') group by 1, 2
""")
def statement_parse(spark, sf):
    return kb.parse_statements(_statements(spark, sf)).where("kind = 'fact'").groupBy("head", "arity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {STATEMENTS} select record_id, cast(pos as int) as pos from tidy
where case when contains(stmt, 'Implication') then contains(stmt, '(Premises') and contains(stmt, '(Conclusions') else not regexp_matches(stmt, '\\$[A-Za-z_][A-Za-z0-9_]*') end
""")
def keep_statements(spark, sf):
    return _statements(spark, sf).where(atoms.keep_statement(F.col("stmt"))).select("record_id", "pos")


@query(f"""
with {STATEMENTS}, r as (
  select record_id, pos, stmt, regexp_extract_all(regexp_extract(stmt, '\\(Premises\\s+((?:\\([^()]+\\)\\s*)+)\\)', 1), '\\([^()]+\\)') as p,
    regexp_extract(stmt, '\\(Premises\\s+(?:\\([^()]+\\)\\s*)+\\)', 0) as whole from tidy where contains(stmt, 'Implication')
), k as (select *, list_filter(p, lambda x: not regexp_matches(x, '^\\(IsA\\s+[$?]\\S+\\s+\\S+\\)$')) as kept from r)
select record_id, cast(pos as int) as pos, case when len(p) > 1 and len(kept) > 0 and len(kept) < len(p) then replace(stmt, whole, '(Premises ' || array_to_string(kept, ' ') || ')') else stmt end as pruned from k
""")
def prune_premises(spark, sf):
    rules = _statements(spark, sf).where(F.contains("stmt", F.lit("Implication")))
    return rules.select("record_id", "pos", atoms.prune_sortal_premises(F.col("stmt")).alias("pruned"))


@query(f"""
with {STATEMENTS}, f as (
  select 'fact' as kind, unnest(regexp_extract_all(stmt, '\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\((?:STV|PointMass|ParticleFromNormal|ParticleFromPairs)', 1)) as a from tidy
  union all
  select 'conclusion', unnest(flatten([regexp_extract_all(b, '\\([^()]+\\)') for b in regexp_extract_all(stmt, '\\(Conclusions\\s+((?:\\([^()]+\\)\\s*)+)\\)', 1)])) from tidy
)
select kind, regexp_extract(a, '^\\(([A-Za-z][A-Za-z0-9_]*)', 1) as head, count(*) as n from f where regexp_matches(a, '^{FLAT}$') and not starts_with(a, '(Implication') group by 1, 2
""")
def signatures(spark, sf):
    s = _statements(spark, sf)
    each = s.select(F.lit("fact").alias("kind"), F.explode(atoms.fact_atoms(F.col("stmt"))).alias("a")).unionByName(s.select(F.lit("conclusion").alias("kind"), F.explode(atoms.conclusion_atoms(F.col("stmt"))).alias("a")))
    return each.groupBy("kind", F.regexp_extract("a", r"^\(([A-Za-z][A-Za-z0-9_]*)", 1).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {STATEMENTS}, v as (select try_cast(regexp_extract(stmt, '\\(STV\\s+([0-9.eE+-]+)\\s+([0-9.eE+-]+)\\s*\\)\\s*\\)$', 1) as double) as s,
  try_cast(regexp_extract(stmt, '\\(STV\\s+([0-9.eE+-]+)\\s+([0-9.eE+-]+)\\s*\\)\\s*\\)$', 2) as double) as c from tidy)
select s as strength, count(*) as n, round(avg(c), 6) as mean_confidence from v where s is not null group by 1
""")
def truth_values(spark, sf):
    tv = _statements(spark, sf).select(atoms.truth_of(F.col("stmt")).alias("tv")).where("tv.s is not null")
    return tv.groupBy(F.col("tv.s").alias("strength")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tv.c"), 6).alias("mean_confidence"))


@query(f"""
with {STATEMENTS}, w as (select record_id, pos, regexp_extract_all(stmt, '[A-Za-z_][A-Za-z0-9_]*') as l from tidy)
select record_id, cast(pos as int) as pos from w where len(list_filter(l, lambda x: contains(x, 'of_the') or contains(x, 'in_culture') or (length(x) >= 32 and contains(x, '_')) or length(regexp_replace(x, '[^_]', '', 'g')) >= 5)) > 0
""")
def overliteral_gate(spark, sf):
    return _statements(spark, sf).where(atoms.overliteral(F.col("stmt"))).select("record_id", "pos")


@query(f"""
with i as (select item_id, text, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as stmt from (select item_id, text, unnest(atoms) as raw from ingest_item_results)),
n as (select item_id, {normal('text')} as words, stmt from i where contains(stmt, 'Implication')),
r as (select item_id, words, stmt, unnest(regexp_extract_all(regexp_extract(stmt, '\\(Premises\\s+((?:\\([^()]+\\)\\s*)+)\\)', 1), '\\([^()]+\\)')) as p from n
  where not (contains(words, ' indicate ') or contains(words, ' indicates ') or contains(words, ' implies ') or contains(words, ' suggest ') or contains(words, ' suggests ') or contains(words, ' if ') or contains(words, ' when '))),
v as (select *, regexp_extract(p, '^{FLAT}$', 1) as head, list_filter(string_split_regex(trim(regexp_extract(p, '^{FLAT}$', 2)), '\\s+'), lambda x: x <> '') as args from r where regexp_matches(p, '^{FLAT}$')),
c as (select *, [{canon("regexp_replace(x, '^[$?]', '')")} for x in args] as bound, [{canon("regexp_replace(x, '^[$?]', '')")} for x in args if regexp_matches(x, '^[$?]')] as vs from v)
select item_id, fact, count(*) as n from (
  select distinct item_id, stmt, '(: materialized_' || {canon('head')} || '_fact (' || head || ' ' || array_to_string(bound, ' ') || ') (STV 1.0 1.0))' as fact
  from c where len(args) > 0 and len(list_filter(vs, lambda x: not list_contains(string_split(words, ' '), x))) = 0) group by 1, 2
""")
def grounded_premises(spark, sf):
    items = table(spark, sf, "ingest_item_results").select("item_id", "text", F.explode("atoms").alias("raw")).select("item_id", "text", atoms.collapse_space(F.col("raw")).alias("stmt")).distinct()
    facts = items.select("item_id", F.explode(hints.grounded_premises(F.col("text"), F.col("stmt"))).alias("fact"))
    return facts.groupBy("item_id", "fact").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {STATEMENTS}, h0 as (select record_id, pos, regexp_extract_all(stmt, '\\(([A-Za-z]\\w*)', 1) as l from tidy),
h as (select record_id, pos, [case when list_contains([{", ".join(f"'{h}'" for h in atoms.STRUCTURAL_HEADS)}], x) then x else coalesce(element_at(map {{{", ".join(f"'{k}': '{v}'" for k, v in atoms.PREDICATE_ALIASES.items())}}}, {canon("x", False)})[1], x) end for x in l] as l from h0)
select record_id, cast(pos as int) as pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ' ') as heads from h
""")
def context_predicates(spark, sf):
    heads = atoms.context_predicates(F.col("stmt"))
    return _statements(spark, sf).select("record_id", "pos", F.array_join(heads, " ").alias("heads"))


# Background triples.


@query(f"with {TRIPLES} select assertion_id, load_batch, predicate, source, target, weight from eligible")
def triples_eligible(spark, sf):
    return triples.eligible(table(spark, sf, "conceptnet_assertions")).select("assertion_id", "load_batch", "predicate", "source", "target", "weight")


@query(f"with {TRIPLES} select predicate, count(*) as n from eligible group by 1")
def relation_counts(spark, sf):
    return triples.relation_counts(triples.eligible(table(spark, sf, "conceptnet_assertions")))


@query(f"with {TRIPLES} select distinct predicate, source, target from eligible where {SCORE} < 0.25")
def hash_sample(spark, sf):
    kept = triples.hash_sample(triples.eligible(table(spark, sf, "conceptnet_assertions")), 25.0)
    return kept.select("predicate", "source", "target").distinct()


@query(f"""
with {TRIPLES}, f as (select predicate, source, target, arg_min(weight, assertion_id * 1000 + load_batch) as weight, arg_min(relation, assertion_id * 1000 + load_batch) as relation from eligible group by 1, 2, 3)
select '(: cnet_' || lower(predicate) || '_' || substr(md5(predicate || '|' || source || '|' || target), 1, 10) || ' (' || predicate || ' ' || source || ' ' || target || ') (STV 1.0 ' || printf('%.4f', least(weight / (weight + 0.2), 0.9999)) || '))' as atom,
  case when relation = '/r/HasProperty' then source || ' is ' || target else replace(source, '_', ' ') || case predicate when 'IsA' then ' is a kind of ' when 'PartOf' then ' is part of ' when 'UsedFor' then ' is used for '
    when 'CapableOf' then ' is capable of ' when 'AtLocation' then ' is located at ' when 'HasA' then ' has a ' else ' is made of ' end || replace(target, '_', ' ') end as nl
from f
""")
def background_export(spark, sf):
    rows = triples.eligible(table(spark, sf, "conceptnet_assertions")).withColumn("seq", F.col("assertion_id") * 1000 + F.col("load_batch"))
    first = triples.dedupe_first(rows.select("predicate", "source", "target", "weight", "relation", "seq"))
    return triples.emit(first).select("atom", "nl")


@query(f"""
with {TRIPLES}, f as (
  select source_file, predicate, source, target, coalesce(predicate is not null and source is not null and target is not null and weight >= 2.0 and not isnan(weight), false) as ok from t0
), k as (select *, ok and coalesce({SCORE} < 0.5, false) as kept from f)
select source_file, cast(count(*) as bigint) as scanned_rows, cast(count(*) filter (ok) as bigint) as eligible_row_count, cast(count(*) filter (kept) as bigint) as sampled_row_count,
  count(distinct case when kept then predicate || ' ' || source || ' ' || target end) as deduped_atom_count from k group by 1
""")
def export_manifest(spark, sf):
    return triples.manifest(table(spark, sf, "conceptnet_assertions"), 2.0, 50.0, 42)


@query("""
select batch_no, count(*) as lines, count(*) filter (ok) as records from (
  select batch_no, coalesce(case when json_valid(line) and json_type(line) = 'OBJECT' then json_extract_string(line, '$.nl') is not null and json_type(line, '$.pln') = 'ARRAY' end, false) as ok from background_jsonl)
group by 1
""")
def background_scan(spark, sf):
    r = F.from_json("line", "nl string, pln array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = table(spark, sf, "background_jsonl").withColumn("r", F.when(F.trim("line").startswith("{"), r))
    good = F.coalesce(F.col("r._bad").isNull() & F.col("r.nl").isNotNull() & F.col("r.pln").isNotNull(), F.lit(False))
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("records"))


# Lookup and rules.

_FACTS = f"""
{STATEMENTS}, facts as (
  select record_id * 1000 + pos as seq, stmt, regexp_extract(stmt, '^\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\(STV\\s+[^()]*\\)\\s*\\)$', 1) as body from tidy
), gs as (
  select item_id * 1000 + pos as goal_id, regexp_extract(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\(', 1) as body
  from (select item_id, unnest(atoms) as raw, unnest(range(len(atoms))) as pos from ingest_item_results)
), goals as (select * from gs where body <> '')
"""


def _goals_and_facts(spark, sf):
    items = table(spark, sf, "ingest_item_results").select("item_id", F.posexplode("atoms").alias("pos", "stmt"))
    body = F.regexp_extract(atoms.collapse_space(F.col("stmt")), r"^\(:\s+[^\s()]+\s+(\([^()]+\))\s+\(", 1)
    goals = items.select((F.col("item_id") * 1000 + F.col("pos")).alias("goal_id"), body.alias("b")).where("b <> ''")
    goals = goals.select("goal_id", F.concat(F.lit("(: $prf "), "b", F.lit(" $tv)")).alias("goal"))
    facts = kb.parse_statements(_statements(spark, sf)).withColumn("seq", F.col("record_id") * 1000 + F.col("pos"))
    return goals, facts.where(atoms.body_of(F.col("stmt")).isNotNull())


@query(f"with {_FACTS} select goal_id, arg_min(stmt, seq) as proof from goals left join facts on facts.body = goals.body and not regexp_matches(goals.body, '[$?]') group by 1")
def fact_lookup_exact(spark, sf):
    return kb.lookup_exact(*_goals_and_facts(spark, sf))


def _canon_key(body: str) -> str:
    return f"case when regexp_matches({body}, '^{FLAT}$') then array_to_string(list_concat([regexp_extract({body}, '^{FLAT}$', 1)], [{canon('a')} for a in string_split_regex(trim(regexp_extract({body}, '^{FLAT}$', 2)), '\\s+') if a <> '']), ' ') end"


@query(f"""
with {_FACTS}, fk as (select seq, stmt, {_canon_key('body')} as k from facts), gk as (select goal_id, case when not regexp_matches(body, '[$?]') then {_canon_key('body')} end as k from goals)
select goal_id, arg_min(stmt, seq) as proof from gk left join fk using (k) group by 1
""")
def fact_lookup_canonical(spark, sf):
    return kb.lookup_canonical(*_goals_and_facts(spark, sf))


LOCATION_RULE = "(: at_region (Implication (Premises (AtLocation $x $n) (PartOf $n $r)) (Conclusions (AtLocation $x $r))) (STV 1.0 0.9))"
_LOCATED = "(select 'supplier_' || s_suppkey as x, s_nationkey as n from supplier union all select 'customer_' || c_custkey, c_nationkey from customer)"


@query(f"select x, 'region_' || n_regionkey as place, 0.9::double as confidence from {_LOCATED} l join nation on n = n_nationkey")
def rule_join_two_premise(spark, sf):
    facts = relational.locations(spark, sf).unionByName(relational.nations(spark, sf))
    out = reasoner.apply_rules(facts, reasoner.parse_rule(LOCATION_RULE))
    return out.select(F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("place"), F.round("c", 6).alias("confidence"))


@query(f"select x as who from {_LOCATED} l join nation on n = n_nationkey where n_regionkey = 1")
def goal_answers(spark, sf):
    facts = relational.locations(spark, sf).unionByName(relational.nations(spark, sf))
    closed = reasoner.fixpoint(facts, reasoner.relevant(reasoner.parse_rule(LOCATION_RULE), "AtLocation"))
    return reasoner.answers(closed, "(: $prf (AtLocation $who region_1) $tv)").select(F.col("$who").alias("who"))


@query("""
with recursive e as (select distinct p_partkey % 97 as a, (p_partkey % 97 * 7 + 1) % 97 as b from part),
c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a)
select 'p_' || a as a, 'p_' || b as b from c
""")
def rule_transitive_closure(spark, sf):
    p = F.col("p_partkey") % 97
    edges = table(spark, sf, "part").select(p.alias("a"), ((p * 7 + 1) % 97).alias("b")).distinct()
    name = lambda c: F.concat(F.lit("p_"), F.col(c).cast("string"))
    facts = edges.select(F.lit("Reaches").alias("head"), F.array(name("a"), name("b")).alias("args"), F.lit(1.0).alias("s"), F.lit(1.0).alias("c"))
    rule = "(: trans (Implication (Premises (Reaches $x $y) (Reaches $y $z)) (Conclusions (Reaches $x $z))) (STV 1.0 1.0))"
    out = reasoner.fixpoint(facts, reasoner.parse_rule(rule))
    return out.select(F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"))


@query()
def rule_transitive_closure_triples(spark, sf):
    """All that IsA and PartOf reach over the eligible triples, each by itself."""
    rows = triples.eligible(table(spark, sf, "conceptnet_assertions")).where(F.col("predicate").isin("IsA", "PartOf"))
    return closure.closure(rows.select("predicate", F.col("source").alias("a"), F.col("target").alias("b")))


@query("select 'part_' || p_partkey as who from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def negation_as_failure(spark, sf):
    """Parts that no order line asks for in the largest quantity."""
    facts = relational.fact(table(spark, sf, "part"), "IsA", relational.named("part", "p_partkey"), F.lit("part"))
    bulk = table(spark, sf, "lineitem").where("l_quantity > 49").select("l_partkey").distinct()
    facts = facts.unionByName(relational.fact(bulk, "Bulk", relational.named("part", "l_partkey"), F.lit("order")))
    rule = "(: small (Implication (Premises (IsA $p part) (Not (Bulk $p order))) (Conclusions (Small $p))) (STV 1.0 1.0))"
    return reasoner.apply_rules(facts, reasoner.parse_rule(rule), closed_world=True).select(F.get("args", F.lit(0)).alias("who"))


@query("""
with recursive e as (select s_suppkey % 11 as a, s_nationkey as b, max(0.4 + (s_suppkey % 3) / 10.0) as c from supplier group by 1, 2),
g as (select 'a' || a as x, 'b' || b as y, c from e union all select 'b' || b, 'a' || ((b * 3) % 11), 0.5 from (select distinct b from e)),
p as (select x, y, c, 1 as n from g union all select x, y, max(c), n from (select p.x, g.y, p.c * g.c as c, n + 1 as n from p join g on p.y = g.x where n < 8 and p.c * g.c > 0.04) group by x, y, n)
select x, y, round(max(c), 6) as confidence from p group by 1, 2 having max(c) > 0.05
""")
def rule_mixed_confidence(spark, sf):
    """The most confident derivation of each pair that a chain of links of mixed confidence reaches, with cycles."""
    s = table(spark, sf, "supplier")
    link = s.select((F.col("s_suppkey") % 11).alias("a"), F.col("s_nationkey").alias("b"), (0.4 + (F.col("s_suppkey") % 3) / 10.0).alias("c")).groupBy("a", "b").agg(F.max("c").alias("c"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    back = link.select("b").distinct().select(F.array(name("b", F.col("b")), name("a", F.col("b") * 3 % 11)).alias("args"), F.lit(0.5).alias("c"))
    facts = link.select(F.array(name("a", F.col("a")), name("b", F.col("b"))).alias("args"), "c").unionByName(back).select(F.lit("Link").alias("head"), "args", F.lit(1.0).alias("s"), "c")
    rule = "(: t (Implication (Premises (Link $x $y) (Link $y $z)) (Conclusions (Link $x $z))) (STV 1.0 1.0))"
    out = reasoner.fixpoint(facts, reasoner.parse_rule(rule)).where("c > 0.05")
    return out.select(F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("y"), F.round("c", 6).alias("confidence"))


@query("select 'customer_' || c_custkey as who from customer where c_acctbal < 0 and c_custkey in (select o_custkey from orders)")
def negation_explicit(spark, sf):
    stmt = F.concat(F.lit("(: poor (Not (Solvent "), relational.named("customer", "c_custkey"), F.lit(")) (STV 1.0 1.0))"))
    poor = kb.parse_statements(table(spark, sf, "customer").where("c_acctbal < 0").select(stmt.alias("stmt"))).select("head", "args", "tv.s", "tv.c")
    rule = "(: risky (Implication (Premises (Ordered $p something) (Not (Solvent $p))) (Conclusions (Risky $p))) (STV 1.0 1.0))"
    return reasoner.apply_rules(poor.unionByName(relational.orders_by(spark, sf)), reasoner.parse_rule(rule)).select(F.get("args", F.lit(0)).alias("who"))


@query("select distinct 'customer_' || c_custkey as who from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def disjunctive_premise(spark, sf):
    rule = "(: heavy (Implication (Premises (Or (IsA $p building) (IsA $p machinery))) (Conclusions (Heavy $p))) (STV 1.0 1.0))"
    return reasoner.apply_rules(relational.classes(spark, sf), reasoner.parse_rule(rule)).select(F.get("args", F.lit(0)).alias("who"))


# Goals.


def _nation_goals(spark, sf):
    """Three goals for each nation: an open one and two ground ones."""
    who = relational.named("nation", "n_nationkey")
    goals = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(("$r", "region_0", "region_3"))])
    n = table(spark, sf, "nation").select("n_nationkey", F.inline(goals))
    return n.select(
        (F.col("n_nationkey") * 10 + F.col("k")).alias("goal_id"),
        F.concat(F.lit("Is "), who, F.lit(" part of a region?")).alias("question"),
        F.concat(F.lit("(: $prf (PartOf "), who, F.lit(" "), "r", F.lit(") $tv)")).alias("goal"),
    )


def _nation_signatures(spark, sf):
    return relational.nations(spark, sf).select("head", "args", F.lit("fact").alias("kind"))


_NATION_SCORES = """
select n_nationkey * 10 + k as goal_id, 'Is nation_' || n_nationkey || ' part of a region?' as question, '(: $prf (PartOf nation_' || n_nationkey || ' ' || r || ') $tv)' as goal,
  6 + case when k > 0 then 3 else 0 end + case when r = 'region_' || n_regionkey then 2 else 0 end as score
from nation, (values (0, '$r'), (1, 'region_0'), (2, 'region_3')) v(k, r)
"""


@query(_NATION_SCORES)
def query_candidate_score(spark, sf):
    return planner.score_goals(_nation_goals(spark, sf), _nation_signatures(spark, sf))


@query(f"with s as ({_NATION_SCORES}) select goal_id, question, goal, score, row_number() over (partition by question order by score desc, goal_id) as rank from s")
def query_plan_rank(spark, sf):
    return planner.rank_goals(planner.score_goals(_nation_goals(spark, sf), _nation_signatures(spark, sf)))


@query("select n_nationkey * 10 as goal_id, '(: $prf (PartOf nation_' || n_nationkey || ' region_' || n_regionkey || ') $tv)' as candidate, 3 as score from nation")
def grounded_fallback(spark, sf):
    return planner.grounded_fallback(_nation_goals(spark, sf), _nation_signatures(spark, sf))


#: Alignment per argument, written from the rule: equal 4, equal in canonical form 3, all parts of the goal's among the
#: signature's 2, a part of the signature's in the question 1.
_ALIGNED = f"""
with g as (select n_nationkey * 10 + k as goal_id, ['nation_' || n_nationkey, r] as q, string_split('is nation ' || n_nationkey || ' part of a region', ' ') as w from nation, (values (1, 'region_0'), (2, 'region_3')) v(k, r)),
s as (select ['nation_' || n_nationkey, 'region_' || n_regionkey] as a from nation),
p as (select goal_id, a, [case when q[i] = a[i] then 4 when {canon('q[i]')} = {canon('a[i]')} then 3
  when len(list_filter(string_split(q[i], '_'), lambda x: not list_contains(string_split(a[i], '_'), x))) = 0 then 2
  when list_has_any(string_split(a[i], '_'), w) then 1 end for i in [1, 2]] as points from g, s)
"""


@query(_ALIGNED + "select goal_id, '(: $prf (PartOf ' || a[1] || ' ' || a[2] || ') $tv)' as candidate, points[1] + points[2] as score from p where points[1] is not null and points[2] is not null")
def aligned_fallback(spark, sf):
    return planner.aligned_fallback(_nation_goals(spark, sf), _nation_signatures(spark, sf))


@query("select 'Is nation_' || n_nationkey || ' part of a region?' as question, '(: $prf (PartOf nation_' || n_nationkey || ' region_' || n_regionkey || ') $tv)' as executed, n_regionkey not in (0, 3) as fallback_used from nation where n_regionkey in (0, 3)")
def candidate_execution(spark, sf):
    """The first ranked goal of each question that a fact proves."""
    goals = _nation_goals(spark, sf)
    facts = relational.nations(spark, sf).select(F.concat(F.lit("("), F.concat_ws(" ", "head", F.array_join("args", " ")), F.lit(")")).alias("body"))
    facts = facts.select("body", F.concat(F.lit("(: f "), "body", F.lit(" (STV 1.0 1.0))")).alias("stmt"), F.lit(0).alias("seq"))
    proofs = kb.lookup_exact(goals, facts)
    ranked = planner.rank_goals(planner.score_goals(goals, _nation_signatures(spark, sf)))
    return planner.first_proved(ranked, proofs).where("executed is not null").select("question", "executed", "fallback_used")


@query(_ALIGNED + f""", own as (select question, 0 as stage, score, goal_id as seq, goal from ({_NATION_SCORES})),
aligned as (select 'Is nation_' || goal_id // 10 || ' part of a region?' as question, 1 as stage, points[1] + points[2] as score, goal_id as seq, '(: $prf (PartOf ' || a[1] || ' ' || a[2] || ') $tv)' as goal from p where points[1] is not null and points[2] is not null),
grounded as (select 'Is nation_' || n_nationkey || ' part of a region?' as question, 2 as stage, 3 as score, n_nationkey * 10 as seq, '(: $prf (PartOf nation_' || n_nationkey || ' region_' || n_regionkey || ') $tv)' as goal from nation),
pattern as (select 'Is nation_' || n_nationkey || ' part of a region?' as question, 3 as stage, 0 as score, 0 as seq, '(: $prf (PartOf nation_' || n_nationkey || ' region) $tv)' as goal from nation),
every as (select * from own union all select * from aligned union all select * from grounded union all select * from pattern),
b as (select question, goal, min({{'stage': stage, 'minus': -score, 'seq': seq}}) as b from every group by 1, 2)
select question, goal, b.stage as stage, row_number() over (partition by question order by b.stage, b.minus, b.seq, goal) as rank from b
""")
def canonical_plan(spark, sf):
    return planner.plan(_nation_goals(spark, sf), _nation_signatures(spark, sf))


_ARGS = "list_filter(string_split_regex(trim(regexp_extract({0}, '^" + FLAT + "$', 2)), '\\s+'), lambda x: x <> '')"


@query(f"""
with {STATEMENTS}, gs as (
  select item_id * 1000 + pos as goal_id, regexp_extract(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\(', 1) as body
  from (select item_id, unnest(atoms) as raw, unnest(range(len(atoms))) as pos from ingest_item_results)
), g as (
  select distinct goal_id, regexp_extract(body, '^{FLAT}$', 1) as head, {_ARGS.format('body')} as args from gs where regexp_matches(body, '^{FLAT}$') and not regexp_matches(body, '[$?][A-Za-z0-9_]')
), f as (
  select 'fact' as kind, unnest(regexp_extract_all(stmt, '\\(:\\s+[^\\s()]+\\s+(\\([^()]+\\))\\s+\\((?:STV|PointMass|ParticleFromNormal|ParticleFromPairs)', 1)) as a from tidy
  union all
  select 'conclusion', unnest(flatten([regexp_extract_all(b, '\\([^()]+\\)') for b in regexp_extract_all(stmt, '\\(Conclusions\\s+((?:\\([^()]+\\)\\s*)+)\\)', 1)])) from tidy
), sg as (
  select distinct kind, regexp_extract(a, '^{FLAT}$', 1) as head, {_ARGS.format('a')} as args from f where regexp_matches(a, '^{FLAT}$') and not starts_with(a, '(Implication')
), shapes as (select head, len(args) as arity, bool_or(kind = 'fact') as fact, bool_or(kind = 'conclusion') as conclusion from sg group by 1, 2),
exact as (select distinct head, args from sg where kind = 'fact')
select goal_id, case when fact then 6 else 0 end + case when conclusion then 4 else 0 end + 3 + case when e.head is not null then 2 else 0 end as score
from g left join shapes on g.head = shapes.head and len(g.args) = arity left join exact e on g.head = e.head and g.args = e.args
""")
def item_goal_scores(spark, sf):
    """The ground goals of all items, asked as yes-no questions, scored against all stored facts and conclusions."""
    goals, _ = _goals_and_facts(spark, sf)
    asked = goals.select("goal_id", F.lit("Is it so?").alias("question"), "goal").where(F.size(atoms.goal_variables(F.col("goal"))) == 0).distinct()
    s = _statements(spark, sf)
    each = s.select(F.lit("fact").alias("kind"), F.explode(atoms.fact_atoms(F.col("stmt"))).alias("a")).unionByName(s.select(F.lit("conclusion").alias("kind"), F.explode(atoms.conclusion_atoms(F.col("stmt"))).alias("a")))
    signatures = each.withColumn("sig", atoms.parse_flat(F.col("a"))).where("sig is not null").select("kind", "sig.head", "sig.args")
    return planner.score_goals(asked, signatures).select("goal_id", "score")


@query("select n_nationkey * 10 + k as goal_id, case when k = 0 then 'weakly_aligned' else 'well_aligned' end as status from nation, (values (0), (1), (2)) v(k)")
def query_status(spark, sf):
    return _nation_goals(spark, sf).select("goal_id", atoms.query_status(F.col("goal"), F.col("question"), F.lit(False)).alias("status"))


def _phrase(x: str) -> str:
    return f"array_to_string([{canon('t')} for t in string_split({x}, ' ') if t not in ('', 'a', 'an', 'the')], '_')"


def _pattern_goal(head: str, p: str) -> str:
    a, b = (_phrase(f"regexp_extract(q, '{p}', {i})") for i in (1, 2))
    return f"when regexp_matches(q, '{p}') and {a} <> '' and {b} <> '' then '(: $prf ({head} ' || {a} || ' ' || {b} || ') $tv)'"


@query(f"""
with n as (select case_id, question, {normal('question')} as q from benchmark_cases),
c as (select case_id, [{canon('t', False)} for t in regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_-]+') if regexp_matches(t, '^[A-Z][A-Za-z0-9_-]*$')] as l from n)
select case_id, case {' '.join(_pattern_goal(h, p) for h, p in planner.PATTERNS)} end as goal, list_filter(l, lambda x, i: x <> '' and list_position(l, x) = i) as constants from n join c using (case_id)
""")
def question_goals(spark, sf):
    return table(spark, sf, "benchmark_cases").select("case_id", planner.question_goal(F.col("question")).alias("goal"), text.question_constants(F.col("question")).alias("constants"))


@query(f"""
with n as (select case_id, {normal('question')} as q from benchmark_cases)
select case_id, array_to_string(list_filter([case when contains(q, 'located at') or contains(q, 'located in') or contains(q, ' in the ') or contains(q, ' in a ') or contains(q, ' in an ') then 'AtLocation' end,
  case when contains(q, 'used for') then 'UsedFor' end, case when contains(q, 'capable of') then 'CapableOf' end, case when contains(q, 'part of') then 'PartOf' end], lambda x: x is not null), ' ') as heads from n
""")
def preferred_heads(spark, sf):
    return table(spark, sf, "benchmark_cases").select("case_id", F.array_join(planner.preferred_heads(F.col("question")), " ").alias("heads"))


# Vectors.


@query("""
with s as (
  select q.vec_id as query_id, p.vec_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 12) as score
  from (select * from embeddings where vec_id % 100 = 0) q, embeddings p
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 10
""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e, e.where(F.col("vec_id") % 100 == 0), 10).withColumn("score", F.round("score", 6))


@query("select source, count(*) as n from vector_records group by 1")
def count_by_source(spark, sf):
    return table(spark, sf, "vector_records").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select record_id from vector_records where source is distinct from 'conceptnet'")
def delete_by_source(spark, sf):
    return kb.delete_by_source(table(spark, sf, "vector_records"), "conceptnet").select("record_id")


@query("with f as (select unnest(pln) as stmt, record_id from vector_records), d as (select stmt, min(record_id) as record_id from f group by 1) select stmt, record_id from d order by record_id desc, stmt desc limit 50")
def context_last50(spark, sf):
    rows = table(spark, sf, "vector_records").select(F.explode("pln").alias("stmt"), "record_id")
    return vectors.last_distinct(rows, "stmt", "record_id", 50)


@query()
def source_lookup(spark, sf):
    """The stored sentences nearest to the sentences of each benchmark case."""
    embed = vectors.hashing_embedder()
    points = table(spark, sf, "vector_records").select(F.col("record_id").alias("vec_id"), "nl", embed(F.col("nl")).alias("embedding"))
    texts = table(spark, sf, "benchmark_cases").select(F.col("case_id").alias("proof_id"), F.transform("texts", lambda t: F.concat(F.lit("("), F.translate(t, "()", ""), F.lit(")"))).alias("p"))
    return vectors.source_lookup(texts.select("proof_id", F.array_join("p", " ").alias("proof")), points, embed)


# Distributions.


@query("""
select l_orderkey, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) as mean, round(sum(case when l_quantity > 25 then l_extendedprice else 0 end) / sum(l_extendedprice), 6) as above
from lineitem group by 1
""")
def weighted_distribution(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("w"))).alias("p"))  # an order has a few lines
    d = dist.normalised(F.col("p"))
    return pairs.select("l_orderkey", F.round(dist.mean(d), 6).alias("mean"), F.round(dist.greater_than(d, F.lit(25.0)), 6).alias("above"))


@query("select p_partkey, round(({}) / 16.0, 6) as above, round(p_retailprice * p_size, 4) as area from part".format(" + ".join(f"case when p_retailprice + p_size * ({z!r})::double > 1000 then 1 else 0 end" for z in normal_particles(16))))
def normal_distribution(spark, sf):
    d = dist.from_normal(F.col("p_retailprice"), F.col("p_size"))
    area = dist.mean(dist.map2_dist(dist.point_mass(F.col("p_retailprice")), dist.point_mass(F.col("p_size")), lambda a, b: a * b))
    return table(spark, sf, "part").select("p_partkey", F.round(dist.greater_than(d, F.lit(1000.0)), 6).alias("above"), F.round(area, 4).alias("area"))


@query("select l_partkey, round(10 + sum(l_quantity), 6) as total, max(l_extendedprice) as dearest, count(*) as n from lineitem group by 1")
def foldall_sum(spark, sf):
    """Folds over all order lines of a part."""
    rows = table(spark, sf, "lineitem")
    total = reasoner.fold_all(rows, ["l_partkey"], F.col("l_quantity"), "+", 10.0).select("l_partkey", F.round("folded", 6).alias("total"))
    most = reasoner.fold_all(rows, ["l_partkey"], F.col("l_extendedprice"), "max").withColumnRenamed("folded", "dearest")
    n = reasoner.fold_all(rows, ["l_partkey"], F.lit(1.0), "count").select("l_partkey", F.col("folded").cast("long").alias("n"))
    return total.join(most, "l_partkey").join(n, "l_partkey")


@query("select l_suppkey, round(avg(l_quantity), 4) as mean, cast(count(distinct l_quantity) as int) as particles from lineitem group by 1")
def average_dist(spark, sf):
    """The average distribution of the quantities (1 to 50) of a supplier's order lines, each a point mass."""
    points = table(spark, sf, "lineitem").select("l_suppkey", dist.point_mass(F.col("l_quantity")).alias("dist"))
    return reasoner.average_dist(points, ["l_suppkey"]).select("l_suppkey", F.round(dist.mean(F.col("dist")), 4).alias("mean"), F.size("dist").alias("particles"))


@query("""
select p_partkey, round((p_size * 2.0 + (p_size + 10) * 2.0) / 2 + 1, 6) as shifted,
  round(((case when p_size > 20 then 1 else 0 end) + (case when p_size > 30 then 1 else 0 end) + (case when p_size + 10 > 20 then 1 else 0 end) + (case when p_size + 10 > 30 then 1 else 0 end)) / 4.0, 6) as greater,
  round((p_size + 5.0) * (p_retailprice + 50.0), 4) as product from part
""")
def greater_than_and_map(spark, sf):
    """A two-point distribution of each part's size: mapped, compared with another distribution and multiplied with one."""
    pair = lambda x, d: dist.from_pairs(F.array(x.cast("double"), (x + d).cast("double")), F.array(F.lit(1.0), F.lit(1.0)))
    size, price = pair(F.col("p_size"), 10), pair(F.col("p_retailprice"), 100)
    return table(spark, sf, "part").select(
        "p_partkey",
        F.round(dist.mean(dist.map_dist(size, lambda x: x * 2 + 1)), 6).alias("shifted"),
        F.round(dist.greater_than_dist(size, pair(F.lit(20), 10)), 6).alias("greater"),
        F.round(dist.mean(dist.reduced(dist.map2_dist(size, price, lambda a, b: a * b))), 4).alias("product"),
    )


@query("select 'supplier_' || l_suppkey as who, round(avg(l_quantity), 4) as mean from lineitem group by 1")
def rule_average_dist(spark, sf):
    """The average quantity of a supplier's order lines by a rule with an AverageDist premise."""
    lines = table(spark, sf, "lineitem")
    who, line = relational.named("supplier", "l_suppkey"), F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    base = relational.fact(lines.select("l_suppkey").distinct(), "Supplier", who, F.lit("known")).withColumn("dist", F.lit(None).cast("array<struct<x:double,w:double>>"))
    made = relational.fact(lines, "QuantityDist", who, line, dist.point_mass(F.col("l_quantity")))
    rule = "(: avg (Implication (Premises (Supplier $s known) (AverageDist (QuantityDist $s $l) -> $d)) (Conclusions (AvgQuantityDist $s))) (STV 1.0 1.0))"
    out = reasoner.apply_rules(base.unionByName(made), reasoner.parse_rule(rule))
    return out.select(F.get("args", F.lit(0)).alias("who"), F.round(dist.mean(F.col("dist")), 4).alias("mean"))


# Metrics.


def _results(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    goal = lambda head: F.concat(F.lit("(: $prf ("), head, F.lit(" a b) $tv)"))
    return e.select(
        (F.col("user_id") % 3).alias("parser"),
        (i % 2 == 0).alias("proof_found"),
        F.when(i % 5 > 0, i % 3 == 0).alias("expected"),
        F.when(i % 7 == 0, "no_query").when(i % 7 == 1, "weakly_aligned").otherwise("well_aligned").alias("status"),
        (i % 11 == 0).alias("fallback_used"),
        F.when(i % 7 > 0, goal(F.col("event_type"))).alias("original_query"),
        F.when(i % 7 > 0, F.when(i % 11 == 0, F.lit("(: $prf (Not (Other a)) $tv)")).otherwise(goal(F.col("event_type")))).alias("executed_query"),
        F.col("value").alias("seconds"),
        F.when(i % 4 > 0, F.col("value") * 2).alias("ingest_seconds"),
        F.when(i % 3 > 0, F.col("value") * 3).alias("query_seconds"),
        F.when(i % 6 > 0, F.col("value") / 2).alias("reasoning_seconds"),
    )


_RESULTS = """
r as (select user_id % 3 as parser, event_id % 2 = 0 as proof_found, case when event_id % 5 > 0 then event_id % 3 = 0 end as expected,
  case when event_id % 7 = 0 then 'no_query' when event_id % 7 = 1 then 'weakly_aligned' else 'well_aligned' end as status, event_id % 11 = 0 as fallback_used, value as seconds,
  case when event_id % 4 > 0 then value * 2 end as ingest_seconds, case when event_id % 3 > 0 then value * 3 end as query_seconds, case when event_id % 6 > 0 then value / 2 end as reasoning_seconds,
  case when event_id % 7 > 0 then event_type else '__unparsed__' end as asked, case when event_id % 7 = 0 then '__unparsed__' when event_id % 11 = 0 then 'Other' else event_type end as run from events)
"""


@query(f"""
with {_RESULTS} select parser, count(*) as cases, count(*) filter (proof_found = expected) as correct, count(expected) as correct_known, count(*) filter (proof_found) as proof_found,
  count(*) filter (status = 'no_query') as no_query, count(*) filter (status = 'weakly_aligned') as weakly_aligned, count(*) filter (fallback_used) as fallback_used,
  round(avg(seconds), 4) as avg_seconds, round(median(seconds), 4) as median_seconds from r group by 1
""")
def parser_summary(spark, sf):
    return metrics.parser_summary(_results(spark, sf))


@query(f"""
with {_RESULTS} select parser, count(*) as cases, count(*) filter (proof_found) as proofs, avg(proof_found::int) as proof_rate, avg(fallback_used::int) as fallback_rate, avg((status = 'no_query')::int) as no_query_rate,
  coalesce(avg((asked <> run)::int) filter (proof_found), 0.0) as proxy_rate, count(*) filter (proof_found and (asked = '__unparsed__' or run = '__unparsed__')) as unparsed_heads,
  median(coalesce(ingest_seconds, 0) + coalesce(query_seconds, 0)) as median_ingest_plus_query, median(reasoning_seconds) as median_reasoning_seconds from r group by 1
""")
def analysis_summary(spark, sf):
    return metrics.analysis_summary(_results(spark, sf))


@query("""
with t as (select unnest(['smoke', 'entailmentbank', 'abstracts']) as suite, unnest([5, 3, 6]) as n),
r as (select b.case_id, b.suite, n, row_number() over (partition by b.suite order by case_id) as k from benchmark_cases b join t using (suite))
select case_id, suite from r where k <= n
""")
def quick_cases(spark, sf):
    return metrics.select_cases(table(spark, sf, "benchmark_cases"), "combined", quick=True).select("case_id", "suite")


@query("""
select s.parser, count(*) as items, count(*) filter (status = 'failed') as failed, sum(chunk_count) as chunks, sum(rejected_count) as rejected
from (select distinct request_id, setting_id from ingest_requests) q join ingest_item_results using (request_id) join ingest_settings s using (setting_id) group by 1
""")
def ingest_report(spark, sf):
    requests = table(spark, sf, "ingest_requests").select("request_id", "setting_id").distinct()
    items = table(spark, sf, "ingest_item_results").join(requests, "request_id").join(table(spark, sf, "ingest_settings").select("setting_id", "parser"), "setting_id")
    return items.groupBy("parser").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("chunk_count").alias("chunks"), F.sum("rejected_count").alias("rejected"))


# Extractions.


def _extractions(spark, sf):
    """Extractions of every class but rules out of the triples: the class by relation, some without an attribute, with a
    variable or with a fuzzy alignment."""
    a = table(spark, sf, "conceptnet_assertions").select("assertion_id", "load_batch", "relation", *[F.regexp_extract(f"{c}_uri", "^/c/[a-z]+/([^/]*)", 1).alias(c) for c in ("start", "end")])
    i = F.col("assertion_id")
    subject = F.when(i % 17 == 0, F.lit("$x")).otherwise(F.replace("start", F.lit("_"), F.lit(" ")))
    cls = (
        F.when(F.col("relation") == "/r/IsA", "type_decl").when(F.col("relation") == "/r/HasProperty", "property").when(F.col("relation") == "/r/PartOf", "inheritance")
        .when(F.col("relation") == "/r/Antonym", "negation").when(F.col("relation") == "/r/RelatedTo", "guess").otherwise("fact")
    )
    named = {"predicate": F.when(i % 13 > 0, F.substring("relation", 4, 40)), "subject": subject, "object": F.col("end"), "entity": subject, "type": F.col("end"), "property": F.lit("quality"), "value": F.col("end"), "child": subject, "parent": F.col("end")}
    pairs = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])
    return a.select("assertion_id", "load_batch", cls.alias("cls"), pairs.alias("attributes"), F.array().cast("array<string>").alias("arguments"), F.when(i % 9 == 0, "MATCH_FUZZY").otherwise("MATCH_EXACT").alias("alignment"))


@query(EXTRACTIONS)
def extraction_translate(spark, sf):
    return extract.translate(_extractions(spark, sf), rules=False).select("assertion_id", "load_batch", "stmt", "reason")


# Event windows (extensions).


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def event_windows(spark, sf):
    return ingest.event_windows(table(spark, sf, "events"))


@query("""
with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as opens from events),
s as (select *, sum(opens) over (partition by user_id order by ts, opens desc rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k
""")
def event_sessions(spark, sf):
    return ingest.sessions(table(spark, sf, "events"))
