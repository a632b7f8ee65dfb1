"""Rules over facts: conjunctions as joins, negation, disjunction, value distributions and a semi-naive fixpoint
(SURVEY J1, J9-J11, R1-R3, A9, A10, V4-V8, E11).

Truth values of derived facts: strength and confidence multiply along a derivation; of several derivations of one
fact the one with the higher confidence, then strength, counts. This is the engine's own choice.

Facts are rows of head, args, s, c and, where they hold value distributions, dist (an array of particles x, w). A negated
fact has the head 'Not:head'.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dist
from factloom.operators.extract import parse_expression
from factloom.session import materialize

FACTS = "head string, args array<string>, s double, c double"
SYMBOL = re.compile(r"[A-Za-z]\w*")
#: Particles of an averaged distribution, at most.
BINS = dist.PARTICLES
CALLS = ("Compute", "GreaterThan", ">", "MapDist", "Map2Dist", "AverageDist", "FoldAll", "FoldAllValue")
FOLDS = {"+": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "*": F.product}


@dataclass(frozen=True)
class Atom:
    head: str
    args: tuple[str, ...]
    negated: bool = False

    @property
    def variables(self) -> set[str]:
        return {a for a in self.args if is_variable(a)}


@dataclass(frozen=True)
class Call:
    """A premise that computes: its inputs are tokens and atoms in order, its result goes to out."""

    op: str
    fn: str
    inputs: tuple[Atom | str, ...]
    out: str | None = None
    value: str | None = None
    init: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    premises: tuple[Atom, ...]
    conclusions: tuple[Atom, ...]
    s: float = 1.0
    c: float = 1.0
    calls: tuple[Call, ...] = field(default=())

    @property
    def reads(self) -> set[str]:
        """Heads of the facts that its calls read."""
        return {i.head for call in self.calls for i in call.inputs if isinstance(i, Atom)}


def is_variable(arg: str) -> bool:
    return arg[:1] in ("$", "?")


def _atom(tree: list | str, negated: bool = False) -> Atom:
    if not isinstance(tree, list) or not tree or not all(isinstance(x, str) for x in tree) or not SYMBOL.fullmatch(tree[0]):
        raise ValueError(f"no flat atom: {str(tree)[:80]}")
    return Atom(tree[0], tuple(tree[1:]), negated)


def parse_atom(text: str) -> Atom:
    """A flat atom, or a negated one."""
    tree = parse_expression(text)
    if isinstance(tree, list) and len(tree) == 2 and tree[0] == "Not":
        return _atom(tree[1], negated=True)
    return _atom(tree)


def _call(tree: list) -> Call:
    """(op fn inputs ... -> out) and (GreaterThan a b)."""
    op, rest, out = tree[0], tree[1:], None
    if "->" in rest:
        at = rest.index("->")
        if at + 2 != len(rest) or not is_variable(rest[at + 1]):
            raise ValueError(f"{op} needs one result variable")
        rest, out = rest[:at], rest[at + 1]
    part = lambda x: _atom(x) if isinstance(x, list) else x
    if op in ("GreaterThan", ">"):
        if len(rest) != 2:
            raise ValueError(f"{op} needs two operands")
        return Call("GreaterThan", ">", tuple(map(part, rest)))
    if out is None:
        raise ValueError(f"{op} has no result")
    if op == "Compute":
        return Call(op, rest[0], tuple(rest[1] if isinstance(rest[1], list) else rest[1:]), out)
    if op in ("FoldAll", "FoldAllValue"):
        pattern, value, init, fn = rest
        return Call("FoldAll", fn, (_atom(pattern),), out, value, init)
    if op == "AverageDist":
        return Call(op, "mean", (_atom(rest[0]),), out)
    return Call(op, rest[0], tuple(map(_atom, rest[1:])), out)


def _alternatives(tree: list | str) -> list[list[Atom | Call]]:
    """The premise as a disjunction of conjunctions."""
    if isinstance(tree, list) and tree and tree[0] == "Or":
        return [b for x in tree[1:] for b in _alternatives(x)]
    if isinstance(tree, list) and tree and tree[0] == "And":
        out: list[list[Atom | Call]] = [[]]
        for x in tree[1:]:
            out = [a + b for a in out for b in _alternatives(x)]
        return out
    if isinstance(tree, list) and tree and tree[0] == "Not":
        return [[_atom(tree[1], negated=True)]]
    if isinstance(tree, list) and tree and tree[0] in CALLS:
        return [[_call(tree)]]
    return [[_atom(tree)]]


def parse_rule(statement: str) -> list[Rule]:
    """Rules of an implication: one per combination of the alternatives of its premises. Raises on other statements."""
    tree = parse_expression(statement)
    if not isinstance(tree, list) or len(tree) < 3 or tree[0] != ":" or not isinstance(tree[2], list) or tree[2][:1] != ["Implication"]:
        raise ValueError("no rule")
    blocks = {b[0]: b[1:] for b in tree[2][1:] if isinstance(b, list) and b}
    if not blocks.get("Premises") or not blocks.get("Conclusions"):
        raise ValueError("a rule needs premises and conclusions")
    bodies: list[list[Atom | Call]] = [[]]
    for item in blocks["Premises"]:
        bodies = [b + x for b in bodies for x in _alternatives(item)]
    heads = tuple(_atom(x[1], negated=True) if isinstance(x, list) and x[:1] == ["Not"] else _atom(x) for x in blocks["Conclusions"])
    tv = tree[3] if len(tree) > 3 and isinstance(tree[3], list) and tree[3][:1] == ["STV"] else ["STV", "1.0", "1.0"]
    s, c = (min(1.0, max(0.0, float(x))) for x in tv[1:3])
    return [Rule(str(tree[1]), tuple(x for x in b if isinstance(x, Atom)), heads, s, c, tuple(x for x in b if isinstance(x, Call))) for b in bodies]


def stored_head(atom: Atom) -> str:
    return f"Not:{atom.head}" if atom.negated else atom.head


def match(facts: DataFrame, atom: Atom, keep: tuple[str, ...] = ("s", "c")) -> DataFrame:
    """Bindings of an atom: one column per variable, and what is kept of the fact. Constants and repeated variables
    become filters."""
    rows = facts.where((F.col("head") == stored_head(atom)) & (F.size("args") == len(atom.args)))
    first: dict[str, int] = {}
    for i, a in enumerate(atom.args):
        at = F.get("args", F.lit(i))
        if not is_variable(a):
            rows = rows.where(at == a)
        elif a in first:
            rows = rows.where(at == F.get("args", F.lit(first[a])))
        else:
            first[a] = i
    return rows.select(*[F.get("args", F.lit(i)).alias(v) for v, i in first.items()], *keep)


def _join_order(sources: list[tuple[Atom, DataFrame]]) -> list[tuple[Atom, DataFrame]]:
    """Premises in an order in which each shares a variable with those before it; ground ones last."""
    todo, out, bound = [x for x in sources if x[0].variables], [], set()
    while todo:
        at = next((i for i, (a, _) in enumerate(todo) if not out or a.variables & bound), None)
        if at is None:
            raise ValueError("a premise shares no variable with the others")
        out.append(todo.pop(at))
        bound |= out[-1][0].variables
    return out + [x for x in sources if not x[0].variables]


def conjunction(sources: list[tuple[Atom, DataFrame]], closed_world: bool = False) -> DataFrame:
    """Joins the premises' bindings on shared variables. Ground premises are one row that is joined or not. Negated
    premises are lookups of explicit negated facts, or, under the closed world, anti joins behind all others."""
    anti = [x for x in sources if closed_world and x[0].negated]
    out: DataFrame | None = None
    for atom, facts in _join_order([x for x in sources if x not in anti]):
        rows = match(facts, atom)
        shared = [c for c in rows.columns if out is not None and c in out.columns and c not in ("s", "c")]
        if not atom.variables:
            rows = rows.agg(F.max(F.struct("c", "s")).alias("t")).where("t is not null").select(F.col("t.s").alias("s"), F.col("t.c").alias("c"), F.lit(1).alias("here"))
            if out is not None:
                out, rows, shared = out.withColumn("here", F.lit(1)), F.broadcast(rows), ["here"]
        if out is None:
            out = rows.drop("here")
            continue
        rows = rows.withColumnsRenamed({"s": "s2", "c": "c2"})
        out = out.join(rows, shared).withColumns({"s": F.col("s") * F.col("s2"), "c": F.col("c") * F.col("c2")}).drop("s2", "c2", "here")
    if out is None:
        raise ValueError("a rule needs a premise that is not negated")
    for atom, facts in anti:
        rows = match(facts, Atom(atom.head, atom.args)).drop("s", "c").distinct()
        shared = [c for c in rows.columns if c in out.columns]
        if not shared:
            raise ValueError("a negated premise shares no variable with the others")
        out = out.join(rows, shared, "left_anti")
    return out


def _number(token: str) -> Column:
    return F.col(f"`{token}`").cast("double") if is_variable(token) else F.lit(float(token))


def _text(number: Column) -> Column:
    return number.cast("double").cast("string")


def _dist_of(out: DataFrame, facts: DataFrame, atom: Atom, name: str) -> DataFrame:
    """out with the distribution of the atom's fact as column name, joined on the variables that both have."""
    rows = match(facts.where("dist is not null"), atom, keep=("dist", "s", "c")).withColumnsRenamed({"dist": name, "s": "s2", "c": "c2"})
    shared = [c for c in rows.columns if c in out.columns]
    if not shared:
        raise ValueError(f"{atom.head} shares no variable with the premises")
    return out.join(rows, shared).withColumns({"s": F.col("s") * F.col("s2"), "c": F.col("c") * F.col("c2")}).drop("s2", "c2")


def average_dist(rows: DataFrame, by: list[str], particles: str = "dist") -> DataFrame:
    """by, and the mean distribution (the equal mixture) of all distributions of a group as at most BINS particles.

    Particles are summed up by cell of an even grid over the group's range, so a group of any size is combined before
    the shuffle; a cell keeps its mean, so the mixture's mean is exact.
    """
    each = rows.select(*[f"`{b}`" for b in by], F.explode(particles).alias("p")).select(*[f"`{b}`" for b in by], "p.x", "p.w")
    span = each.groupBy(*[f"`{b}`" for b in by]).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
    cells = each.join(span, by).withColumn("cell", cell).groupBy(*[f"`{b}`" for b in by], "cell").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    gathered = cells.groupBy(*[f"`{b}`" for b in by]).agg(F.array_sort(F.collect_list(F.struct((F.col("wx") / F.col("w")).alias("x"), "w"))).alias("d"))
    return gathered.select(*[f"`{b}`" for b in by], dist.normalised(F.col("d")).alias(particles))


def fold_all(rows: DataFrame, by: list[str], value: Column, fn: str, init: float = 0.0) -> DataFrame:
    """by, and the fold of value over all rows of a group from init: sum, product, min, max or count, which combine before
    the shuffle and do not depend on an order (A9)."""
    total = FOLDS[fn](value)
    combined = {"+": total + init, "sum": total + init, "count": total + init, "*": total * init, "min": F.least(total, F.lit(init)), "max": F.greatest(total, F.lit(init))}[fn]
    return rows.groupBy(*[f"`{b}`" for b in by]).agg(combined.alias("folded"))


def apply_call(out: DataFrame, call: Call, facts: DataFrame) -> DataFrame:
    """out with a call's result as a new column, or filtered and weighed by a comparison."""
    if call.op == "Compute":
        return out.withColumn(call.out, _text(dist.compute(call.fn, *map(_number, call.inputs))))
    if call.op == "GreaterThan":
        sides = []
        for k, side in enumerate(call.inputs):
            if isinstance(side, Atom):
                out = _dist_of(out, facts, side, f"_side{k}")
                sides.append(F.col(f"_side{k}"))
            elif is_variable(side) and dict(out.dtypes).get(side, "").startswith("array"):
                sides.append(F.col(f"`{side}`"))
            else:
                sides.append(dist.point_mass(_number(side)))
        out = out.withColumn("_p", dist.greater_than_dist(*sides)).where("_p > 0")
        return out.withColumn("s", F.col("s") * F.col("_p")).drop("_p", "_side0", "_side1")
    if call.op in ("MapDist", "Map2Dist"):
        names = [f"_in{k}" for k in range(len(call.inputs))]
        for name, atom in zip(names, call.inputs):
            out = _dist_of(out, facts, atom, name)
        fn = lambda *x: dist.compute(call.fn, *x)
        made = dist.map_dist(F.col(names[0]), fn) if len(names) == 1 else dist.reduced(dist.map2_dist(F.col(names[0]), F.col(names[1]), fn))
        return out.withColumn(call.out, made).drop(*names)
    atom = call.inputs[0]
    shared = sorted(atom.variables & set(out.columns))
    if not shared:
        raise ValueError(f"{atom.head} shares no variable with the premises")
    if call.op == "AverageDist":
        rows = average_dist(match(facts.where("dist is not null"), atom, keep=("dist",)), shared).withColumnRenamed("dist", call.out)
    else:
        value = F.lit(1.0) if call.value is None else _number(call.value)
        rows = fold_all(match(facts, atom), shared, value, call.fn, float(call.init)).select(*[f"`{c}`" for c in shared], _text(F.col("folded")).alias(call.out))
    return out.join(rows, shared)


def bindings(rule: Rule, sources: list[DataFrame], all_: DataFrame, closed_world: bool = False) -> DataFrame:
    """Bindings of a rule's premises and calls. Calls see all facts."""
    out = conjunction(list(zip(rule.premises, sources)), closed_world)
    for call in rule.calls:
        out = apply_call(out, call, all_)
    return out


def conclude(found: DataFrame, rule: Rule) -> DataFrame:
    """The rule's conclusions; a distribution that its last call made is their value."""
    made = next((c.out for c in reversed(rule.calls) if c.op in ("MapDist", "Map2Dist", "AverageDist")), None)
    out: DataFrame | None = None
    for atom in rule.conclusions:
        args = F.array(*[F.col(f"`{a}`") if is_variable(a) else F.lit(a) for a in atom.args]).cast("array<string>")
        extra = [F.col(f"`{made}`").alias("dist")] if made else []
        rows = found.select(F.lit(stored_head(atom)).alias("head"), args.alias("args"), (F.col("s") * rule.s).alias("s"), (F.col("c") * rule.c).alias("c"), *extra)
        out = rows if out is None else out.unionByName(rows)
    return out


def best(facts: DataFrame) -> DataFrame:
    """One row per fact: the highest confidence, then strength."""
    if "dist" in facts.columns:
        top = F.max_by(F.struct("s", "c", "dist"), F.struct(F.col("c"), F.col("s")))
        return facts.groupBy("head", "args").agg(top.alias("tv")).select("head", "args", "tv.s", "tv.c", "tv.dist")
    return facts.groupBy("head", "args").agg(F.max(F.struct("c", "s")).alias("tv")).select("head", "args", F.col("tv.s").alias("s"), F.col("tv.c").alias("c"))


def apply_rules(facts: DataFrame, rules: list[Rule], closed_world: bool = False) -> DataFrame:
    """Conclusions of one application of all rules."""
    out: DataFrame | None = None
    for rule in rules:
        rows = conclude(bindings(rule, [facts] * len(rule.premises), facts, closed_world), rule)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return best(out)


def relevant(rules: list[Rule], goal_head: str) -> list[Rule]:
    """Rules from which the goal's predicate can be reached."""
    wanted, kept = {goal_head}, []
    while True:
        more = [r for r in rules if r not in kept and any(stored_head(a) in wanted or a.head in wanted for a in r.conclusions)]
        if not more:
            return kept
        kept += more
        wanted |= {p.head for r in more for p in r.premises} | {h for r in more for h in r.reads}


def fixpoint(facts: DataFrame, rules: list[Rule], max_rounds: int | None = None, closed_world: bool = False) -> DataFrame:
    """All facts that follow with their best truth values, semi-naive: in each round every rule joins the newest facts
    with all facts.

    Newest are facts that were unknown, or known with a lower confidence or, at equal confidence, strength. Truth values
    are at most 1 and multiply, so a cycle improves nothing and the rounds end; max_rounds raises an error where more would
    be needed. Rounds are written to the shared folder, so a plan never grows with the number of rounds and a lost
    executor costs a reread; every eighth keeps the best of each fact only. Rules with calls follow in strata of their own,
    once all that their calls read is derived.
    """
    if closed_world:
        derived = {a.head for r in rules for a in r.conclusions}
        if any(p.negated and p.head in derived for r in rules for p in r.premises):
            raise ValueError("negation under the closed world needs predicates that no rule derives")
    plain, calling = [r for r in rules if not r.calls], [r for r in rules if r.calls]
    with_dist = "dist" in facts.columns
    keep = ["head", "args", "s", "c", *(["dist"] if with_dist or calling else [])]
    if calling and not with_dist:
        facts = facts.withColumn("dist", F.lit(None).cast("array<struct<x:double,w:double>>"))
    one = {k: F.least(F.coalesce(k, F.lit(1.0)), F.lit(1.0)) for k in ("s", "c")}
    all_ = materialize(best(facts.withColumns(one).select(*keep)).sortWithinPartitions("head"), "facts")
    all_, repeats = _rounds(all_, all_, plain, max_rounds, closed_world)
    left = calling
    while left:
        ready = [r for r in left if not any(a.head in r.reads | {p.head for p in r.premises} for o in left if o is not r for a in o.conclusions)] or left
        if any(a.head in r.reads for r in ready for a in r.conclusions):
            raise ValueError("a call reads what its own rule derives")
        left = [r for r in left if r not in ready]
        for rule in ready:
            rows = conclude(bindings(rule, [all_] * len(rule.premises), all_, closed_world), rule)
            fresh = _improved(best(rows.unionByName(all_.limit(0), allowMissingColumns=True).select(*keep)), all_)
            delta = materialize(fresh, "delta").drop("known")
            all_, more = _rounds(all_.unionByName(delta), delta, plain, max_rounds, closed_world)
            repeats = True
    return best(all_) if repeats else all_


def _improved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (one per fact) that are not known, or known with lower truth values only (column known)."""
    old = known.groupBy("head", "args").agg(F.max(F.struct("c", "s")).alias("old"))
    better = F.col("old").isNull() | (F.struct("c", "s") > F.col("old"))
    return rows.join(old, ["head", "args"], "left").where(better).select(*rows.columns, F.col("old").isNotNull().alias("known"))


def _rounds(all_: DataFrame, delta: DataFrame, rules: list[Rule], max_rounds: int | None, closed_world: bool) -> tuple[DataFrame, bool]:
    """All facts after the last round, and whether some are in it more than once, with lower truth values."""
    rounds, new_heads, repeats = 0, None, False
    while True:
        out: DataFrame | None = None
        for rule in rules:
            for i, newest in enumerate(rule.premises):
                if (newest.negated and closed_world) or (new_heads is not None and stored_head(newest) not in new_heads):
                    continue
                sources = [delta if k == i else all_ for k in range(len(rule.premises))]
                rows = conclude(bindings(rule, sources, all_, closed_world), rule)
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return all_, repeats
        fresh = _improved(best(out), all_)
        if "dist" in all_.columns:
            fresh = fresh.withColumn("dist", F.lit(None).cast(dict(all_.dtypes)["dist"]))
        delta = materialize(fresh, "delta")
        if delta.isEmpty():
            return all_, repeats
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"facts still follow after {max_rounds} rounds")
        found = delta.select("head", "known").distinct().collect()  # at most two per conclusion
        new_heads, repeats = {r.head for r in found}, repeats or any(r.known for r in found)
        delta = delta.drop("known")
        all_ = all_.unionByName(delta)
        if rounds % 8 == 0:
            all_, repeats = materialize(best(all_).sortWithinPartitions("head"), "facts"), False


def goal_atom(goal: str) -> Atom:
    """The atom of a goal (: $prf atom $tv), or of an atom by itself."""
    tree = parse_expression(goal)
    if isinstance(tree, list) and tree[:1] == [":"] and len(tree) > 2:
        tree = tree[2]
    if isinstance(tree, list) and len(tree) == 2 and tree[0] == "Not":
        return _atom(tree[1], negated=True)
    return _atom(tree)


def answers(facts: DataFrame, goal: str) -> DataFrame:
    """Bindings of a goal's variables over facts, with s and c, and the distribution where facts have one."""
    return match(facts, goal_atom(goal), keep=("s", "c", "dist") if "dist" in facts.columns else ("s", "c"))
