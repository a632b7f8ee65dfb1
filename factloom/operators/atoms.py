"""Statements as columns: validation, parsing, canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import canonical_symbol, let, singularize

# Heads with a meaning of their own, and other spellings of predicates.
STRUCTURAL_HEADS = (
    "Implication", "Premises", "Conclusions", "STV", "And", "Or", "Not", "IsA", "PointMass", "ParticleFromNormal",
    "ParticleFromPairs", "GreaterThan", "MapDist", "Map2Dist", "AverageDist", "FoldAll", "FoldAllValue", "Compute",
)
PREDICATE_ALIASES = {
    "isa": "IsA", "is_a": "IsA", "kind_of": "IsA", "type_of": "IsA", "located_at": "AtLocation", "locatedat": "AtLocation",
    "used_for": "UsedFor", "usedfor": "UsedFor", "capable_of": "CapableOf", "capableof": "CapableOf", "part_of": "PartOf", "partof": "PartOf",
}

FLAT = r"\(([A-Za-z][A-Za-z0-9_]*)((?:\s+[^()\s]+)*)\)"
STATEMENT = r"^\(:\s+([^\s()]+)\s+(.+)\)$"


def collapse_space(statement: Column) -> Column:
    return F.trim(F.regexp_replace(statement, r"\s+", " "))


def balanced(text: Column) -> Column:
    """Whether parentheses never close before they open and all are closed: matched pairs are removed by the engine's
    own string functions, depth is followed over the parentheses only."""
    marks = F.split(F.regexp_replace(text, r"[^()]", ""), "")

    def step(acc: Column, c: Column) -> Column:
        depth = acc["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("d"), F.least(acc["low"], depth).alias("low"))

    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))
    return F.aggregate(marks, start, step, lambda acc: (acc["d"] == 0) & (acc["low"] >= 0))


def invalid_reason(statement: Column) -> Column:
    """First rule that a statement breaks, NULL if it is valid. NULL statements break the first."""
    s = F.coalesce(statement, F.lit(""))
    rule_like = F.contains(s, F.lit("Implication"))
    return (
        F.when(~s.startswith("(:"), "missing_prefix")
        .when(~s.rlike(r"\((STV|PointMass|ParticleFrom)"), "missing_weight")
        .when(~balanced(s), "unbalanced_parens")
        .when(~s.rlike(STATEMENT), "bad_toplevel")
        .when(F.regexp_extract(s, STATEMENT, 1).rlike(r"^[$?]"), "variable_name")
        .when(rule_like & ~(F.contains(s, F.lit("(Premises")) & F.contains(s, F.lit("(Conclusions"))), "bad_implication_shape")
    )


def validate(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """Statements with white space collapsed and empty ones dropped, and the reason of those to be rejected."""
    tidy = statements.withColumn(column, collapse_space(F.col(column))).where(F.col(column) != "")
    return tidy.withColumn("reason", invalid_reason(F.col(column)))


def keep_statement(statement: Column) -> Column:
    """Drops malformed implications and plain statements with a $variable."""
    rule_like = F.contains(statement, F.lit("Implication"))
    shaped = F.contains(statement, F.lit("(Premises")) & F.contains(statement, F.lit("(Conclusions"))
    return F.when(rule_like, shaped).otherwise(~statement.rlike(r"\$[A-Za-z_][A-Za-z0-9_]*"))


def parse_flat(atom: Column) -> Column:
    """struct(head, args, arity, variables) of a flat atom, NULL otherwise."""
    a = F.trim(atom)
    args = F.filter(F.split(F.trim(F.regexp_extract(a, f"^{FLAT}$", 2)), r"\s+"), lambda x: x != "")
    return F.when(
        a.rlike(f"^{FLAT}$"),
        let(args, lambda v: F.struct(F.regexp_extract(a, f"^{FLAT}$", 1).alias("head"), v.alias("args"), F.size(v).alias("arity"), F.filter(v, lambda x: x.rlike(r"^[$?]")).alias("variables"))),
    )


def body_of(statement: Column) -> Column:
    """Body of a statement with an STV truth value; NULL for others."""
    found = F.regexp_extract(statement, r"^\(:\s+[^\s()]+\s+(.+)\s+\(STV\s+[^()]*\)\s*\)$", 1)
    return F.nullif(found, F.lit(""))


def truth_of(statement: Column) -> Column:
    """struct(s, c) of the STV truth value; NULL for others."""
    pattern = r"\(STV\s+([0-9.eE+-]+)\s+([0-9.eE+-]+)\s*\)\s*\)$"
    return F.when(
        statement.rlike(pattern),
        F.struct(F.regexp_extract(statement, pattern, 1).try_cast("double").alias("s"), F.regexp_extract(statement, pattern, 2).try_cast("double").alias("c")),
    )


def name_of(statement: Column) -> Column:
    return F.nullif(F.regexp_extract(statement, STATEMENT, 1), F.lit(""))


def goal_atom(goal: Column) -> Column:
    """Inner flat atom of a goal (: $prf (P ...) $tv); NULL where there is none."""
    return F.nullif(F.regexp_extract(goal, r"\(:\s+[^\s()]+\s+(\([^()]+\))\s+\$?[A-Za-z_][A-Za-z0-9_]*\)", 1), F.lit(""))


def ground_goal(goal: Column) -> Column:
    """Body of a goal whose proof and truth value are variables and which holds no other; NULL otherwise."""
    body = F.regexp_extract(F.trim(goal), r"^\(:\s+[$?]\S+\s+(\(.+\))\s+[$?][^\s()]+\)$", 1)
    return F.when((body != "") & ~body.rlike(r"[$?]"), body)


def fact_atoms(text: Column) -> Column:
    """All flat bodies of facts in a text, with any kind of truth value."""
    found = F.regexp_extract_all(text, F.lit(r"\(:\s+[^\s()]+\s+(\([^()]+\))\s+\((?:STV|PointMass|ParticleFromNormal|ParticleFromPairs)"), F.lit(1))
    return F.filter(found, lambda a: a.rlike(f"^{FLAT}$") & ~a.startswith("(Implication"))


def conclusion_atoms(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"\(Conclusions\s+((?:\([^()]+\)\s*)+)\)"), F.lit(1))
    return F.filter(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\([^()]+\)"), F.lit(0)))), lambda a: a.rlike(f"^{FLAT}$"))


def premise_atoms(text: Column) -> Column:
    block = F.regexp_extract(text, r"\(Premises\s+((?:\([^()]+\)\s*)+)\)", 1)
    return F.regexp_extract_all(block, F.lit(r"\([^()]+\)"), F.lit(0))


def prune_sortal_premises(statement: Column) -> Column:
    """Drops (IsA $v C) among several flat premises of a rule, unless none would be left. It widens the rule."""
    premises = premise_atoms(statement)
    kept = F.filter(premises, lambda p: ~p.rlike(r"^\(IsA\s+[$?]\S+\s+\S+\)$"))
    changed = F.concat(F.lit("(Premises "), F.array_join(kept, " "), F.lit(")"))
    whole = F.regexp_extract(statement, r"\(Premises\s+(?:\([^()]+\)\s*)+\)", 0)
    prune = F.contains(statement, F.lit("Implication")) & (F.size(premises) > 1) & (F.size(kept) > 0) & (F.size(kept) < F.size(premises))
    return F.when(prune, F.replace(statement, whole, changed)).otherwise(statement)


def canonical_head(token: Column) -> Column:
    pairs = [F.lit(x) for kv in PREDICATE_ALIASES.items() for x in kv]
    alias = F.try_element_at(F.create_map(*pairs), canonical_symbol(token, lemmatize=False))
    return F.when(token.isin(*STRUCTURAL_HEADS), token).otherwise(F.coalesce(alias, token))


def normalize_isa(atom: Column) -> Column:
    """(IsA x C) with the class in canonical form; other flat atoms as they are."""
    p = r"^\(IsA\s+([^()\s]+)\s+([^()\s]+)\)$"
    return F.when(atom.rlike(p), F.concat(F.lit("(IsA "), F.regexp_extract(atom, p, 1), F.lit(" "), canonical_symbol(F.regexp_extract(atom, p, 2)), F.lit(")"))).otherwise(atom)


def canonical_atom(atom: Column) -> Column:
    """Flat atom with its head by alias and its constants in canonical form; variables keep their mark."""
    sig = parse_flat(atom)

    def arg(x: Column) -> Column:
        mark = F.substring(x, 1, 1)
        return F.when(mark.isin("$", "?"), F.concat(mark, canonical_symbol(x.substr(F.lit(2), F.length(x)), lemmatize=False))).otherwise(canonical_symbol(x))

    return let(sig, lambda s: F.when(s.isNotNull(), F.concat(F.lit("("), F.concat_ws(" ", canonical_head(s["head"]), F.transform(s["args"], arg)), F.lit(")"))))


def context_predicates(text: Column, limit: int = 12, structural: bool = True) -> Column:
    heads = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\(([A-Za-z]\w*)"), F.lit(1)), canonical_head))
    return F.slice(heads if structural else F.array_except(heads, F.array(*map(F.lit, STRUCTURAL_HEADS))), 1, limit)


def context_heads(context: Column) -> Column:
    """Heads of an array of statements but for the structural ones of the extraction path, each once (T18)."""
    found = F.flatten(F.transform(context, lambda t: F.regexp_extract_all(t, F.lit(r"\(([A-Za-z][A-Za-z0-9_]*)"), F.lit(1))))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, ("Implication", "Premises", "Conclusions", "STV", "And", "Or", "Not", "IsA"))))


def goal_variables(goal: Column) -> Column:
    found = F.regexp_extract_all(goal, F.lit(r"[$?]\w+"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, ("$prf", "$tv", "?prf", "?tv"))))


def query_status(goal: Column, question: Column, fallback_used: Column) -> Column:
    from factloom.functions.text import is_yes_no

    weak = fallback_used | (is_yes_no(question) & (F.size(goal_variables(goal)) > 0))
    return F.when(goal.isNull() | (F.trim(goal) == ""), "no_query").when(weak, "weakly_aligned").otherwise("well_aligned")


def overliteral(text: Column) -> Column:
    """Whether a symbol reads like a copied phrase."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.exists(
        words,
        lambda w: F.contains(w, F.lit("of_the")) | F.contains(w, F.lit("in_culture")) | ((F.length(w) >= 32) & F.contains(w, F.lit("_"))) | (F.length(F.regexp_replace(w, "[^_]", "")) >= 5),
    )


def singular_symbols(symbols: Column) -> Column:
    return F.transform(symbols, singularize)
