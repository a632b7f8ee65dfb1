"""Statements and goals of a translator in canonical form.

Everything is a Column over arrays of one text: its statements or goals, and at most a few tens of context statements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import canonical_symbol, extract_concepts, let, pluralize, proper_name_map, protected_constants
from factloom.operators import atoms

PIECE = r"[$?\p{L}_][\p{L}\p{N}_]*|[^$?\p{L}_]+"
ISA = r"\(IsA\s+([^()\s]+)\s+([^()\s]+)\)"


def ordered_distinct(items: Column) -> Column:
    """Items with white space collapsed, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(items, atoms.collapse_space), lambda x: x != ""))


def _first_entries(pairs: Column) -> Column:
    """Map of the pairs (k, v), of several with one key the first."""
    return let(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda p, i: (p["k"] != "") & ~F.exists(F.slice(all_, 1, i), lambda q: q["k"] == p["k"]))))


def symbol_map(context: Column) -> Column:
    """Map of each constant of the context's facts and conclusions, its singular and its plural form, to the constant."""
    found = F.concat(F.flatten(F.transform(context, atoms.fact_atoms)), F.flatten(F.transform(context, atoms.conclusion_atoms)))
    constants = F.flatten(F.transform(found, lambda a: F.filter(atoms.parse_flat(a)["args"], lambda x: ~x.rlike(r"^[$?]"))))

    def entries(x: Column) -> Column:
        single = canonical_symbol(x)
        keys = F.array(x, single, F.when(single != "", pluralize(single)).otherwise(""))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), x.alias("v")))

    return _first_entries(F.flatten(F.transform(F.array_distinct(constants), entries)))


def concept_map(text: Column) -> Column:
    """Map of a text's concepts and their plural forms to the concept."""
    pairs = F.flatten(F.transform(extract_concepts(text), lambda c: F.array(F.struct(c.alias("k"), c.alias("v")), F.struct(pluralize(c).alias("k"), c.alias("v")))))
    return _first_entries(pairs)


def canonical_statement(statement: Column, names: Column, symbols: Column, concepts: Column, protected: Column) -> Column:
    """Every identifier of a statement in canonical form: variables keep their mark, heads go through the aliases, names,
    symbols of the context and concepts through their maps, all others become canonical symbols."""

    def one(piece: Column, before: Column) -> Column:
        low, mark = F.lower(piece), F.substring(piece, 1, 1)
        other = canonical_symbol(piece, protect=F.array_contains(protected, low))
        mapped = F.coalesce(F.try_element_at(names, low), F.try_element_at(symbols, low), F.try_element_at(concepts, low), other)
        return (
            F.when(~piece.rlike(r"^[$?\p{L}_]"), piece)
            .when(mark.isin("$", "?"), F.concat(mark, canonical_symbol(piece.substr(F.lit(2), F.length(piece)), lemmatize=False)))
            .when(F.coalesce(before.rlike(r"\(\s*$"), F.lit(False)), atoms.canonical_head(piece))
            .otherwise(mapped)
        )

    pieces = F.regexp_extract_all(statement, F.lit(PIECE), F.lit(0))
    return let(pieces, lambda all_: F.array_join(F.transform(all_, lambda p, i: one(p, F.get(all_, i - 1))), ""))


def isa_classes(statement: Column) -> Column:
    """The classes of all IsA atoms of a statement as canonical symbols; variables stay variables."""
    pieces = F.regexp_extract_all(statement, F.lit(ISA.replace("([^", "[^").replace("]+)", "]+") + r"|\(|[^(]+"), F.lit(0))
    changed = F.transform(pieces, lambda p: F.when(p.rlike(f"^{ISA}$") & ~p.rlike(r"[$?]\S+\)$"), F.concat(F.lit("(IsA "), F.regexp_extract(p, ISA, 1), F.lit(" "), canonical_symbol(F.regexp_extract(p, ISA, 2)), F.lit(")"))).otherwise(p))
    return F.array_join(changed, "")


def canonical_items(text: Column, items: Column, context: Column) -> Column:
    """The items in canonical form, each once, in order."""
    maps = F.struct(proper_name_map(text).alias("names"), symbol_map(context).alias("symbols"), concept_map(text).alias("concepts"), protected_constants(text).alias("protected"))

    def all_items(m: Column) -> Column:
        return F.transform(ordered_distinct(items), lambda s: isa_classes(canonical_statement(s, m["names"], m["symbols"], m["concepts"], m["protected"])))

    return ordered_distinct(let(maps, all_items))


def statements(text: Column, items: Column, context: Column) -> Column:
    """The whole pipeline for statements: canonical form, generic premises pruned, malformed and open ones dropped."""
    pruned = F.transform(canonical_items(text, items, context), atoms.prune_sortal_premises)
    return F.filter(pruned, atoms.keep_statement)


def goals(text: Column, items: Column, context: Column) -> Column:
    """Goals in canonical form; the planner ranks them."""
    return canonical_items(text, items, context)
