"""What the translators are told: vocabulary, proper names, question hints, grounded premises."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import canonical_symbol, extract_concepts, is_yes_no, let, normalize_text, split_sentences
from factloom.operators import atoms

# Question words and words of conditional texts.
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which")
CONDITIONAL_WORDS = (" indicate ", " indicates ", " implies ", " suggest ", " suggests ", " if ", " when ")

EXISTENTIAL_WORDS = ("any", "anything", "someone", "somebody", "something")
#: What a translator is told of the form of statements.
POLICY = (
    "; structural heads stay as they are: Implication, Premises, Conclusions, STV, And, Not",
    "; IsA is the predicate of class membership",
    "; entities and classes in lower snake case, nouns and verbs in their base form",
    "; heads and symbols of the context are used again",
)


def proper_names(text: Column) -> Column:
    """Words that are capitalised wherever they do not open a sentence, in lower case and sorted."""
    inner = F.flatten(F.transform(split_sentences(text), lambda s: let(F.split(s, r"\s+"), lambda w: F.slice(w, 2, F.size(w)))))
    clean = F.filter(F.transform(inner, lambda w: F.regexp_extract(w, r"[A-Za-z][A-Za-z0-9_]*", 0)), lambda w: w != "")

    def kept(words: Column) -> Column:
        upper = F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]")), F.lower)
        return F.array_sort(F.array_distinct(F.array_except(upper, F.filter(words, lambda w: ~w.rlike("^[A-Z]")))))

    return let(clean, kept)


def vocabulary_hint(statements: Column, limit: int = 24) -> Column:
    """'; known predicates: A, B' of a context text; NULL where it has none."""
    heads = atoms.context_predicates(statements, limit, structural=False)
    return F.when(F.size(heads) > 0, F.concat(F.lit("; known predicates: "), F.array_join(heads, ", ")))


def question_hints(question: Column, context: Column, full: bool = False) -> Column:
    """Hint lines for a question: its intent, wording and the context's first five predicates, and with full those on
    existential and negated wording."""
    words = F.split(normalize_text(question), " ")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    heads = F.slice(atoms.context_predicates(context), 1, 5)
    lines = [F.when(is_yes_no(question), "; intent: yes-no question, prefer a goal that can be proved directly").when(has(*QUESTION_WORDS), "; intent: open question, prefer a goal with a variable")]
    if full:
        lines.append(F.when(has(*EXISTENTIAL_WORDS), "; existential wording: a helper predicate is allowed where no direct goal can be derived"))
        lines.append(F.when(has("not", "never"), "; negation only where facts or rules state it"))
    lines.append(F.when(F.size(heads) > 0, F.concat(F.lit("; predicates to use first: "), F.array_join(heads, ", "))))
    lines.append(F.when(question.endswith("?"), "; keep what the question asks and a goal that can be run"))
    return F.when(normalize_text(question) == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(*lines), lambda x: x.isNotNull()))


def batch_hints(text: Column, context: Column) -> Column:
    """Hint lines for a batch of texts: the fixed policy, at most 12 concepts of the text and 8 predicates of the context."""
    concepts, heads = extract_concepts(text, 12), F.slice(atoms.context_predicates(context), 1, 8)
    fixed = [F.lit(line) for line in POLICY]
    some = [
        F.when(F.size(concepts) > 0, F.concat(F.lit("; concepts: "), F.array_join(concepts, ", "))),
        F.when(F.size(heads) > 0, F.concat(F.lit("; preferred predicates: "), F.array_join(heads, ", "))),
    ]
    return F.filter(F.array(*fixed, *some), lambda x: x.isNotNull())


def grounded_premises(text: Column, statement: Column) -> Column:
    """Facts from the flat premises of a rule whose variables are all named by words of the text, each variable bound to
    its name; premises without a variable hold as they are. Conditional texts state no facts and give none; NULL for
    statements that are no rules."""
    low = normalize_text(text)
    conditional = F.lit(False)
    for w in CONDITIONAL_WORDS:
        conditional = conditional | F.contains(low, F.lit(w))
    words = F.split(low, " ")

    def one(premise: Column) -> Column:
        sig = atoms.parse_flat(premise)
        bound = F.transform(sig["args"], lambda a: canonical_symbol(F.regexp_replace(a, r"^[$?]", "")))
        named = F.forall(F.filter(sig["args"], lambda a: a.rlike(r"^[$?]")), lambda a: F.array_contains(words, canonical_symbol(F.regexp_replace(a, r"^[$?]", ""))))
        fact = F.concat(F.lit("(: materialized_"), canonical_symbol(sig["head"]), F.lit("_fact ("), F.concat_ws(" ", sig["head"], bound), F.lit(") (STV 1.0 1.0))"))
        return F.when(sig.isNotNull() & named & (sig["arity"] > 0), fact)

    facts = F.array_distinct(F.filter(F.transform(atoms.premise_atoms(statement), one), lambda x: x.isNotNull()))
    return F.when(F.contains(statement, F.lit("Implication")), F.when(conditional, F.array().cast("array<string>")).otherwise(facts))


@functools.lru_cache(maxsize=16)
def prompt_examples(path: str) -> tuple:
    """Examples of a prompt file, read once per path."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return tuple(json.dumps(x, sort_keys=True) for x in (data if isinstance(data, list) else data.get("examples", [])))
