"""Goals: question patterns, scores, ranking and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import canonical_phrase, canonical_symbol, is_yes_no, let, normalize_text, question_constants
from factloom.operators import atoms

# Question patterns in normalised text and the predicate they ask for.
PATTERNS = (
    ("HasA", r"^(?:does|do|did|has|have|had)\s+(.+?)\s+have\s+(.+)$"),
    ("UsedFor", r"^(?:is|are|was|were)\s+(.+?)\s+used for\s+(.+)$"),
    ("CapableOf", r"^(?:is|are|was|were|can|could)\s+(.+?)\s+capable of\s+(.+)$"),
    ("PartOf", r"^(?:is|are|was|were)\s+(.+?)\s+part of\s+(.+)$"),
    ("AtLocation", r"^(?:is|are|was|were)\s+(.+?)\s+located (?:at|in|on)\s+(.+)$"),
)
# Phrases of a question and the predicate they prefer.
PREFERRED = (
    ("AtLocation", ("located at", "located in", " in the ", " in a ", " in an ")),
    ("UsedFor", ("used for",)),
    ("CapableOf", ("capable of",)),
    ("PartOf", ("part of",)),
)


def pattern_goals(question: Column) -> Column:
    """Goals of a question by all patterns that fit, in order."""

    def goals(q: Column) -> Column:
        out = []
        for head, p in PATTERNS:
            a, b = (canonical_phrase(F.regexp_extract(q, p, i)) for i in (1, 2))
            out.append(F.when(q.rlike(p) & (a != "") & (b != ""), F.concat(F.lit(f"(: $prf ({head} "), a, F.lit(" "), b, F.lit(") $tv)"))))
        return F.filter(F.array(*out), lambda g: g.isNotNull())

    return let(normalize_text(question), goals)


def question_goal(question: Column) -> Column:
    """Goal of a yes-no question by the first pattern that fits; NULL otherwise."""
    return F.get(pattern_goals(question), F.lit(0))


def preferred_heads(question: Column) -> Column:
    q = normalize_text(question)
    hits = []
    for head, phrases in PREFERRED:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(q, F.lit(phrase))
        hits.append(F.when(hit, head))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def signature_to_query(head: Column, args: Column) -> Column:
    """The goal that asks for a signature (T47)."""
    return F.concat(F.lit("(: $prf ("), F.concat_ws(" ", head, F.array_join(args, " ")), F.lit(") $tv)"))


def _variable(x: Column) -> Column:
    return x.rlike(r"^[$?]")


def can_bind(query_args: Column, args: Column) -> Column:
    """Whether a query's arguments meet a signature's: constants equal, and a variable meets a constant if there is one."""
    pairs = F.arrays_zip(query_args.alias("q"), args.alias("a"))
    agrees = F.forall(pairs, lambda p: _variable(p["q"]) | (p["q"] == p["a"]))
    witness = F.exists(pairs, lambda p: _variable(p["q"]) & ~_variable(p["a"])) | ~F.exists(query_args, _variable)
    return agrees & witness


def _by_first_constant(goals: DataFrame) -> DataFrame:
    """goals(..., args) with the place and value of their first constant; NULLs where there is none."""
    place = F.array_position(F.transform("args", lambda a: ~_variable(a)), True)
    return goals.withColumn("place", F.nullif(place, F.lit(0)).cast("int")).withColumn("constant", F.get("args", F.col("place") - 1))


def _by_place(signatures: DataFrame) -> DataFrame:
    """A row for each constant of each distinct signature, by its place."""
    s = signatures.select("head", "args").distinct()
    rows = s.select(F.col("head").alias("s_head"), F.size("args").alias("s_arity"), F.col("args").alias("s_args"), F.posexplode("args").alias("p", "s_constant"))
    return rows.where(~_variable(F.col("s_constant"))).select("s_head", "s_arity", "s_args", (F.col("p") + 1).alias("s_place"), "s_constant")


def score_goals(goals: DataFrame, signatures: DataFrame) -> DataFrame:
    """goals(goal_id, question, goal) with a score against signatures(head, args, kind 'fact' or 'conclusion').

    Signatures are first reduced per (head, arity) for the shape flags; the exact match is an equi join on (head, args).
    A witness is a semi join on the goal's first constant and its place; a goal of variables only is witnessed by any
    constant of its shape. No goal is paired with the signatures of its predicate.
    """
    g = goals.withColumn("sig", atoms.parse_flat(atoms.goal_atom(F.col("goal")))).where(F.col("sig").isNotNull())
    g = g.select("*", "sig.head", "sig.args", "sig.arity", (F.size("sig.variables") > 0).alias("open"), is_yes_no(F.col("question")).alias("yes_no")).drop("sig")
    shapes = signatures.groupBy("head", F.size("args").alias("arity")).agg(
        F.max(F.col("kind") == "fact").alias("fact"), F.max(F.col("kind") == "conclusion").alias("conclusion"), F.max(F.exists("args", lambda a: ~_variable(a))).alias("constant")
    )
    exact = signatures.where(F.col("kind") == "fact").select("head", "args").distinct().withColumn("exact", F.lit(True))
    asked = _by_first_constant(g.where(F.col("open") & F.col("yes_no")))
    places = _by_place(signatures)
    on = [asked[c] == places[f"s_{c}"] for c in ("head", "arity", "place", "constant")]
    witnessed = asked.where("constant is not null").join(places, [*on, can_bind(asked["args"], places["s_args"])], "left_semi").select("goal_id").distinct().withColumn("witness", F.lit(True))
    free = F.col("open") & F.forall("args", _variable) & F.col("constant")
    out = g.join(shapes, ["head", "arity"], "left").join(exact, ["head", "args"], "left").join(witnessed, "goal_id", "left").withColumn("witness", F.coalesce("witness", free))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    points = (
        F.when(flag("fact"), 6).otherwise(0)
        + F.when(flag("conclusion"), 4).otherwise(0)
        + F.when(~F.col("open"), F.when(F.col("yes_no"), 3).otherwise(1)).otherwise(F.when(F.col("yes_no"), 0).otherwise(3))
        + F.when(flag("exact"), 2).otherwise(0)
    )
    lost = (F.col("yes_no") & F.col("open") & ~flag("witness")) | (points <= 0)
    return out.select("goal_id", "question", "goal", F.when(~lost, points).alias("score"))


def rank_goals(scored: DataFrame, by: str = "question", order: str = "goal_id") -> DataFrame:
    """Scored goals in order of falling score, each once; where a question keeps none, its first goal."""
    alive = scored.where(F.col("score").isNotNull()).withColumn("copy", F.row_number().over(W.partitionBy(by, "goal").orderBy(F.desc("score"), order))).where("copy = 1").drop("copy")
    first = scored.groupBy(by).agg(F.min(F.struct(order, "goal")).alias("f"), F.count("score").alias("n")).where("n = 0")
    rest = first.select(F.col(f"f.{order}").alias(order), by, F.col("f.goal").alias("goal"), F.lit(None).cast("int").alias("score"))
    return alive.select(order, by, "goal", "score").unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last("score"), order)))


def grounded_fallback(goals: DataFrame, signatures: DataFrame) -> DataFrame:
    """For open goals of yes-no questions: ground signatures that can answer them, with scores 5 for each that holds a
    capitalised symbol of the question, 3 for facts and 2 for conclusions.

    A goal with a constant meets the signatures that have it in its place; one of variables only meets all of its shape,
    as all of them are its result.
    """
    g = goals.withColumn("sig", atoms.parse_flat(atoms.goal_atom(F.col("goal")))).where((F.size("sig.variables") > 0) & is_yes_no(F.col("question")))
    g = _by_first_constant(g.select("goal_id", question_constants(F.col("question")).alias("symbols"), "sig.head", "sig.args", "sig.arity"))
    ground = signatures.where(~F.exists("args", _variable))
    kinds = ground.groupBy("head", F.col("args").alias("s_args")).agg(F.max(F.col("kind") == "fact").alias("fact"), F.max(F.col("kind") == "conclusion").alias("conclusion"))
    places = _by_place(ground)
    on = [g[c] == places[f"s_{c}"] for c in ("head", "arity", "place", "constant")]
    met = g.where("constant is not null").join(places, on).select("goal_id", "symbols", "head", "args", "s_args").join(kinds, ["head", "s_args"])
    shape = g.where("constant is null").join(kinds.withColumn("arity", F.size("s_args")), ["head", "arity"]).select(*met.columns)
    met = met.unionByName(shape).where(can_bind(F.col("args"), F.col("s_args")))
    score = F.when(F.arrays_overlap("symbols", "s_args"), 5).otherwise(0) + F.when(F.col("fact"), 3).otherwise(0) + F.when(F.col("conclusion"), 2).otherwise(0)
    return met.select("goal_id", signature_to_query(F.col("head"), F.col("s_args")).alias("candidate"), score.alias("score"))


def alignment_score(args: Column, other: Column, heads_differ: Column, question_words: Column) -> Column:
    """Per argument 4 if equal, 3 if equal in canonical form, 2 if all its parts are parts of the signature's, 1 if the
    question names a part of the signature's; -1 in all as soon as one has none of these. Different heads add 3."""

    def one(a: Column, b: Column) -> Column:
        pa, pb = F.split(a, "_"), F.split(b, "_")
        return (
            F.when(a == b, 4)
            .when(canonical_symbol(a) == canonical_symbol(b), 3)
            .when(F.size(F.array_except(pa, pb)) == 0, 2)
            .when(F.arrays_overlap(pb, question_words), 1)
        )

    total = F.aggregate(F.zip_with(args, other, one), F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(total + F.when(heads_differ, 3).otherwise(0), F.lit(-1))


def aligned_fallback(goals: DataFrame, signatures: DataFrame) -> DataFrame:
    """Ground goals against signatures of the heads that the question's wording prefers, by alignment.

    An aligned first argument shares a part, as it is or in canonical form, with the goal's first argument or with the
    question, so goals and signatures meet by (head, arity, part) and not by their predicate.
    """
    parts = lambda a: F.array_union(F.split(a, "_"), F.split(canonical_symbol(a), "_"))
    none = F.array(F.lit(""))
    g = goals.withColumn("sig", atoms.parse_flat(atoms.goal_atom(F.col("goal")))).where(F.size("sig.variables") == 0)
    g = g.select("goal_id", F.col("sig.head").alias("own"), "sig.args", "sig.arity", F.split(normalize_text(F.col("question")), " ").alias("words"), F.explode(preferred_heads(F.col("question"))).alias("head"))
    sought = F.when(F.col("arity") == 0, none).otherwise(F.array_union(parts(F.get("args", F.lit(0))), F.col("words")))
    s = signatures.select("head", F.col("args").alias("s_args"), F.size("args").alias("arity")).distinct()
    held = F.when(F.col("arity") == 0, none).otherwise(parts(F.get("s_args", F.lit(0))))
    met = g.withColumn("part", F.explode(sought)).join(s.withColumn("part", F.explode(held)), ["head", "arity", "part"]).drop("part")
    scored = met.withColumn("score", alignment_score(F.col("args"), F.col("s_args"), F.col("own") != F.col("head"), F.col("words"))).where(F.col("score") > 0)
    return scored.select("goal_id", signature_to_query(F.col("head"), F.col("s_args")).alias("candidate"), "score").distinct()


def first_proved(ranked: DataFrame, proofs: DataFrame, by: str = "question") -> DataFrame:
    """Of each question's ranked goals the first with a proof, and whether it is another than the first goal."""
    tried = ranked.join(proofs, "goal_id", "left")
    proved = F.col("proof").isNotNull() & (F.col("proof") != "") & (F.col("proof") != "[]")
    return tried.groupBy(by).agg(
        F.min_by("goal", F.when(proved, F.col("rank"))).alias("executed"),
        F.min_by("proof", F.when(proved, F.col("rank"))).alias("proof"),
        F.min_by("goal", "rank").alias("original"),
    ).withColumn("fallback_used", F.coalesce(F.col("executed") != F.col("original"), F.lit(False)))


def merge_ordered(first: Column, second: Column) -> Column:
    """Items of both arrays, each once, in order of first appearance."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def preserves_grounded(query_args: Column, args: Column, question_symbols: Column) -> Column:
    """Whether a signature keeps a query's constants, and holds the question's symbols that the query holds."""
    pairs = F.arrays_zip(query_args.alias("q"), args.alias("a"))
    asked = F.filter(query_args, lambda a: ~_variable(a) & F.array_contains(question_symbols, a))
    return F.forall(pairs, lambda p: _variable(p["q"]) | (p["q"] == p["a"])) & (F.size(F.array_except(asked, args)) == 0)


def plan(goals: DataFrame, signatures: DataFrame) -> DataFrame:
    """question, goal, stage and rank of all candidates: scored goals, then aligned and grounded signatures, then the
    question's own patterns (the last two for yes-no questions). Aligned signatures are for questions that keep a goal; a
    yes-no question that keeps none goes on with all its goals, another one with its first. A candidate found at several
    stages counts at the first."""
    asked = goals.select("goal_id", "question").distinct()
    yes_no = is_yes_no(F.col("question"))
    scored = score_goals(goals, signatures)
    alive = scored.where(F.col("score").isNotNull()).select("question").distinct()
    own = rank_goals(scored).where(F.col("score").isNotNull() | ~yes_no).select("question", F.lit(0).alias("stage"), F.coalesce("score", F.lit(0)).alias("score"), F.col("goal_id").alias("seq"), "goal")
    lost = goals.join(alive, "question", "left_anti")
    lost_goals = lost.where(yes_no).select("question", F.lit(0).alias("stage"), F.lit(0).alias("score"), F.col("goal_id").alias("seq"), "goal")
    kept = scored.where(F.col("score").isNotNull()).select("goal_id")
    aligned = aligned_fallback(goals.join(kept, "goal_id", "left_semi"), signatures).join(asked, "goal_id").select("question", F.lit(1).alias("stage"), "score", F.col("goal_id").alias("seq"), F.col("candidate").alias("goal"))
    grounded = grounded_fallback(goals, signatures).join(asked, "goal_id").select("question", F.lit(2).alias("stage"), "score", F.col("goal_id").alias("seq"), F.col("candidate").alias("goal"))
    patterns = goals.where(yes_no).select("question", F.posexplode(pattern_goals(F.col("question"))).alias("seq", "goal"))
    pattern = patterns.select("question", F.lit(3).alias("stage"), F.lit(0).alias("score"), F.col("seq").cast("long").alias("seq"), "goal")
    every = own.unionByName(lost_goals).unionByName(aligned).unionByName(grounded).unionByName(pattern)
    best = every.groupBy("question", "goal").agg(F.min(F.struct("stage", (-F.col("score")).alias("minus"), "seq")).alias("b"))
    rank = F.row_number().over(W.partitionBy("question").orderBy("b.stage", "b.minus", "b.seq", "goal"))
    return best.select("question", "goal", F.col("b.stage").alias("stage"), rank.alias("rank"))


def retry_goals(more: DataFrame, tried: int, max_tries: int, by: str = "question") -> DataFrame:
    """Candidates of a second stage that the budget still allows, in their order: max_tries less those tried, 0 for all."""
    if not max_tries:
        return more
    left = max(0, max_tries - tried)
    return more.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where(F.col("k") <= left).drop("k")


def cap_candidates(ranked: DataFrame, max_tries: int, fallback: bool = True) -> DataFrame:
    """Candidates that are tried: one without fallback, else max_tries, 0 for all."""
    most = max_tries if fallback else 1
    return ranked.where(F.col("rank") <= most) if most else ranked
