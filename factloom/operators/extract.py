"""Extractions to statements and goals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import INVARIANT_ENDINGS, INVARIANT_NOUNS, argument_list, let, pascal_symbol, singularize_keep, snake_symbol

# Classes of extractions, exact alignments, names of the is-a relation and structural heads.
CLASSES = ("fact", "type_decl", "property", "inheritance", "rule", "negation")
EXACT = ("MATCH_EXACT", "MATCH_GREATER", "MATCH_LESSER")
ISA_NAMES = ("isa", "Inheritance", "IsA", ":")
STRUCTURAL = {"and": "And", ",": "And", "or": "Or", "not": "Not", "And": "And", "Or": "Or", "Not": "Not"}
DEFAULT_TV = "(STV 1.0 1.0)"
VALUE_KEYS = ("subject", "object", "entity", "type", "value", "child", "parent")


def tokenize(expression: str) -> list[str]:
    return expression.replace("(", " ( ").replace(")", " ) ").split()


def parse_expression(expression: str) -> list | str:
    """Nested lists of an S-expression. Raises on empty input, a missing ')' and trailing tokens; no recursion, so depth
    is bounded by memory only."""
    tokens = tokenize(expression)
    if not tokens:
        raise ValueError("empty expression")
    if tokens[0] != "(":
        if len(tokens) > 1:
            raise ValueError("trailing tokens")
        return tokens[0]
    stack: list[list] = []
    for i, t in enumerate(tokens):
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            if not stack:
                if i + 1 < len(tokens):
                    raise ValueError("trailing tokens")
                return done
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    raise ValueError("missing )")


def flatten_premises(tree: list | str) -> list:
    """Premises of a rule body: conjunctions are flattened, (match &self x ...) is unwrapped, or and not stay whole."""
    if isinstance(tree, list) and len(tree) >= 4 and tree[0] == "match" and tree[1] == "&self":
        tree = tree[2]
    out, todo = [], [tree]
    while todo:
        item = todo.pop()
        if not isinstance(item, list) or not item:
            raise ValueError("a premise must be an expression")
        if item[0] in (",", "and", "And"):
            todo += reversed(item[1:])
        else:
            out.append(item)
    if not out:
        raise ValueError("no premises")
    return out


# The same rules as value(), predicate() and statement_name() below, for the nested expressions of rules.


def _singular(word: str) -> str:
    if len(word) <= 3 or word in INVARIANT_NOUNS:
        return word
    for end, cut, add in (("ies", 3, "y"), ("ses", 2, "")):
        if word.endswith(end) and len(word) > 4:
            return word[:-cut] + add
    plural = word.endswith("s") and not word.endswith(("ss", "us", "is") + INVARIANT_ENDINGS)
    return word[:-1] if plural else word


def _snake(text: str, lower: bool = True) -> str:
    s = re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text.strip())).strip("_")
    return s.lower() if lower else s


def _value(text: str) -> str:
    if text[:1] in ("$", "?"):
        return "$" + _snake(text[1:], lower=False)
    return _snake("-".join(t if "-" in t or any(c.isdigit() for c in t) else _singular(t.lower()) for t in text.split()))


def _head(text: str, arity: int) -> str:
    if text in STRUCTURAL:
        return STRUCTURAL[text]
    if text in ISA_NAMES and arity == 2:
        return "IsA"
    parts = re.findall(r"[A-Za-z0-9]+", text)
    return "".join(p.capitalize() for p in parts) or text


def render(tree: list | str) -> str:
    """An expression as an atom: heads by predicate, arguments in canonical form."""
    if isinstance(tree, str):
        return _value(tree)
    if not tree or not isinstance(tree[0], str):
        raise ValueError("a predicate must be an expression")
    return "(" + " ".join([_head(tree[0], len(tree) - 1), *map(render, tree[1:])]) + ")"


def _premises(body):
    try:
        return [render(p) for p in flatten_premises(parse_expression(body))]
    except (ValueError, IndexError, RecursionError):
        return None


def rule_premises(body: Column) -> Column:
    """Premises of a rule body as atoms; NULL if the body cannot be parsed. Rules are few beside facts."""
    return F.udf(_premises, T.ArrayType(T.StringType()), useArrow=True)(body)


def attribute(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("attributes", F.lit(name))), F.lit(""))


def value(x: Column, proper: Column | None = None) -> Column:
    """Argument in canonical form: its words in the singular, but for those with a hyphen or a digit; names by the map
    proper (lower case to spelling), where given. Variables keep their case."""

    def token(t: Column) -> Column:
        low = F.lower(t)
        base = singularize_keep(low) if proper is None else F.coalesce(F.try_element_at(proper, low), singularize_keep(low))
        return F.when(t.rlike(r"[-0-9]"), t).otherwise(base)

    words = F.array_join(F.transform(F.split(F.trim(x), r"\s+"), token), "-")
    return F.when(x.rlike(r"^\s*[$?]"), F.concat(F.lit("$"), snake_symbol(F.regexp_replace(x, r"^\s*[$?]", ""), preserve_case=True))).otherwise(snake_symbol(words))


def predicate(x: Column, arity: Column) -> Column:
    pairs = [F.lit(v) for kv in STRUCTURAL.items() for v in kv]
    plain = F.when(x.isin(*ISA_NAMES) & (arity == 2), "IsA").otherwise(pascal_symbol(F.replace(F.lower(x), F.lit(" "), F.lit("-"))))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), plain)


def proper_spellings(source_text: Column) -> Column:
    """Map of lower-case words to their spelling, for words that begin with a capital wherever they do not open a
    sentence (T20)."""
    sentences = F.filter(F.split(source_text, r"(?<=[.!?])\s+"), lambda s: s != "")
    word = F.lit(r"\b([A-Za-z][A-Za-z0-9_'-]*)\b")
    inner = F.flatten(F.transform(sentences, lambda s: let(F.regexp_extract_all(s, word, F.lit(1)), lambda w: F.slice(w, 2, F.size(w)))))

    def kept(words: Column) -> Column:
        first = F.filter(words, lambda w, i: ~F.exists(F.slice(words, 1, i), lambda v: F.lower(v) == F.lower(w)))
        names = F.filter(first, lambda w: ~F.exists(words, lambda v: (F.lower(v) == F.lower(w)) & ~v.rlike("^[A-Z]")))
        return F.map_from_arrays(F.transform(names, F.lower), names)

    return let(inner, kept)


def reject_reason(skip_fuzzy: bool = True) -> Column:
    """Why an extraction is not translated, before it is built; NULL where it is."""
    fuzzy = F.col("alignment").isNotNull() & ~F.col("alignment").isin(*EXACT)
    out = F.when(fuzzy, "fuzzy alignment") if skip_fuzzy else F.when(F.lit(False), "")
    cls = F.coalesce(F.trim("cls"), F.lit(""))
    out = out.when(~cls.isin(*CLASSES), F.concat(F.lit("unsupported statement class '"), cls, F.lit("'")))
    for n in VALUE_KEYS:
        free = F.coalesce(attribute(n).rlike(r"^[$?]"), F.lit(False))
        out = out.when((cls != "rule") & free, F.concat(F.lit(f"free variable in '{n}' for "), cls))
    out = out.when((cls == "rule") & attribute("head_predicate").isNull(), "rule has empty head_predicate")
    return out.when((cls == "rule") & attribute("body").isNull(), "rule has empty body")


def missing_reason(classes: tuple[str, ...] = CLASSES) -> Column:
    """The first attribute that an extraction needs and lacks."""
    need = {"fact": ("predicate",), "negation": ("predicate",), "type_decl": ("entity", "type"), "property": ("entity", "property", "value"), "inheritance": ("child", "parent"), "query": ("predicate",)}
    out = F.when(F.lit(False), "")
    for cls, names in need.items():
        for n in names:
            out = out.when((F.col("cls") == cls) & attribute(n).isNull(), f"missing required attribute '{n}'")
    return out.when(F.col("cls").isin("fact", "negation") & (F.size("expr_args") == 0), "fact requires at least one argument").when((F.col("cls") == "query") & (F.size("expr_args") == 0), "query requires at least one argument")


def with_expression(extractions: DataFrame) -> DataFrame:
    """Adds expr_head and expr_args: every class is first brought to one shape, so that the rules for heads, arguments and
    names are evaluated once a row and not once a class."""
    cls = F.col("cls")
    listed = F.when(F.size("arguments") > 0, F.filter(F.transform("arguments", lambda x: F.trim(x)), lambda x: x != ""))
    pair = F.filter(F.array(attribute("subject"), attribute("object")), lambda x: x.isNotNull())
    own = F.coalesce(listed, F.when(attribute("arguments").isNotNull(), F.array(attribute("arguments"))), pair)
    asked = F.coalesce(listed, argument_list(attribute("arguments")), pair)
    head_args = F.coalesce(argument_list(attribute("head_args")), F.array(F.lit("$x")))
    args = (
        F.when(cls.isin("fact", "negation"), own)
        .when(cls == "query", asked)
        .when(cls == "type_decl", F.array(attribute("entity"), attribute("type")))
        .when(cls == "inheritance", F.array(attribute("child"), attribute("parent")))
        .when(cls == "property", F.array(attribute("entity"), attribute("property"), attribute("value")))
        .when(cls == "rule", head_args)
    )
    head = F.when(cls.isin("type_decl", "inheritance"), "isa").when(cls == "property", "has").when(cls == "rule", attribute("head_predicate")).otherwise(attribute("predicate"))
    return extractions.withColumns({"expr_head": head, "expr_args": args})


def expression_atom(proper: Column | None = None) -> Column:
    args = F.transform("expr_args", lambda a: value(a, proper))
    return F.concat(F.lit("("), F.concat_ws(" ", predicate(F.col("expr_head"), F.size("expr_args")), args), F.lit(")"))


def statement_name() -> Column:
    """At most two arguments, the head and what the class adds, cut to 80 characters."""
    suffixes = {"fact": "fact", "type_decl": "type", "property": "property", "inheritance": "inheritance", "negation": "neg", "rule": "rule"}
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]), F.col("cls"))
    args = F.transform(F.slice("expr_args", 1, 2), lambda a: value(F.regexp_replace(a, r"^[$?]+", "")))
    head = snake_symbol(F.replace(F.lower("expr_head"), F.lit(" "), F.lit("-")))
    return F.substring(F.concat_ws("_", F.filter(F.concat(args, F.array(head, suffix)), lambda x: x != "")), 1, 80)


def _built(e: DataFrame, proper: str | None, truth_value: str) -> DataFrame:
    """Adds the statement to rows that have a reason or whatever their class needs."""
    atom = expression_atom(F.col(proper) if proper else None)
    negated = F.when(F.col("cls") == "negation", F.concat(F.lit("(Not "), atom, F.lit(")"))).otherwise(atom)
    if "premises" in e.columns:
        rule = F.concat(F.lit("(Implication (Premises "), F.array_join("premises", " "), F.lit(") (Conclusions "), atom, F.lit("))"))
        e = e.withColumn("reason", F.coalesce("reason", F.when(F.col("premises").isNull(), "rule body unparseable")))
        negated = rule
    whole = F.when(F.col("reason").isNull(), negated)
    return e.withColumn("stmt", F.concat(F.lit("(: "), statement_name(), F.lit(" "), whole, F.lit(f" {truth_value})"))).drop("premises", "expr_head", "expr_args")


def translate(extractions: DataFrame, skip_fuzzy: bool = True, truth_value: str = DEFAULT_TV, proper: str | None = None, rules: bool = True) -> DataFrame:
    """extractions(cls, attributes map, arguments array, alignment) with a statement, or the reason there is none.

    Rules go through Python for their nested bodies, all other rows stay in the JVM. proper names a column of spellings;
    rules=False is for tables known to hold none.
    """
    e = with_expression(extractions).withColumn("reason", F.coalesce(reject_reason(skip_fuzzy), missing_reason()))
    if not rules:
        return _built(e, proper, truth_value)
    is_rule = F.coalesce(F.col("cls") == "rule", F.lit(False)) & F.col("reason").isNull()
    plain = _built(e.where(~is_rule), proper, truth_value)
    return plain.unionByName(_built(e.where(is_rule).withColumn("premises", rule_premises(attribute("body"))), proper, truth_value))


def distinct_statements(translated: DataFrame, by: str, order: str) -> DataFrame:
    """The statements of each text once, at their first place (T37)."""
    return translated.where(F.col("stmt").isNotNull()).groupBy(by, "stmt").agg(F.min(order).alias(order))


def goals(extractions: DataFrame, proper: str | None = None) -> DataFrame:
    """The extractions read as goals: queries and the classes of statements; rules are none."""
    known = F.coalesce(F.col("cls").isin(*CLASSES, "query"), F.lit(False))
    e = with_expression(extractions)
    reason = F.when(~known, F.concat(F.lit("unsupported query class '"), F.coalesce("cls", F.lit("")), F.lit("'"))).when(F.col("cls") == "rule", "query cannot target a rule").otherwise(missing_reason())
    atom = expression_atom(F.col(proper) if proper else None)
    body = F.when(F.col("cls") == "negation", F.concat(F.lit("(Not "), atom, F.lit(")"))).otherwise(atom)
    e = e.withColumn("reason", reason)
    return e.withColumn("goal", F.when(F.col("reason").isNull(), F.concat(F.lit("(: $prf "), body, F.lit(" $tv)")))).drop("expr_head", "expr_args")


def predicate_heads(extractions: DataFrame, order: str) -> DataFrame:
    """The predicates that extractions name, in lower case with hyphens, each once at its first place (T18, A14)."""
    names = extractions.select(order, F.posexplode(F.array(attribute("predicate"), attribute("head_predicate"))).alias("k", "name")).where("name is not null")
    key = F.replace(F.lower("name"), F.lit(" "), F.lit("-"))
    return names.groupBy(key.alias("head")).agg(F.min(F.struct(order, "k")).alias("at")).select("head", F.col(f"at.{order}").alias(order))


def vocabulary_pairs(heads: Column, context: Column, limit: int = 24) -> Column:
    """'head->kebab-head' of the first heads of both, for a translator's prompt (T40)."""
    from factloom.functions.text import kebab_symbol
    from factloom.operators.atoms import context_heads

    every = F.slice(F.array_distinct(F.concat(heads, context_heads(context))), 1, limit)
    return F.array_join(F.transform(every, lambda h: F.concat(h, F.lit("->"), kebab_symbol(h))), ", ")
