"""Background-triple ETL: scan, map, clean, weigh, sample, dedupe, emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import canonical_symbol

# Raw relation -> predicate.
RELATIONS = {
    "/r/IsA": "IsA",
    "/r/HasProperty": "IsA",
    "/r/PartOf": "PartOf",
    "/r/UsedFor": "UsedFor",
    "/r/CapableOf": "CapableOf",
    "/r/AtLocation": "AtLocation",
    "/r/HasA": "HasA",
    "/r/MadeOf": "MadeOf",
}

# Sentence of a predicate.
SENTENCES = {
    "IsA": "%s is a kind of %s",
    "PartOf": "%s is part of %s",
    "UsedFor": "%s is used for %s",
    "CapableOf": "%s is capable of %s",
    "AtLocation": "%s is located at %s",
    "HasA": "%s has a %s",
    "MadeOf": "%s is made of %s",
}

LANGUAGE_PREFIX = "/c/en/"
NORMALIZATION_VERSION = 1


def predicate_of(relation: Column) -> Column:
    pairs = [x for raw, pred in RELATIONS.items() for x in (F.lit(raw), F.lit(pred))]
    return F.try_element_at(F.create_map(*pairs), relation)


def clean_concept(uri: Column) -> Column:
    """Canonical term of an English concept; NULL for other languages, NULL or empty terms."""
    term = F.regexp_extract(uri, "^" + LANGUAGE_PREFIX + "([^/]*)", 1)
    symbol = F.when(uri.startswith(LANGUAGE_PREFIX), canonical_symbol(term))
    return F.nullif(symbol, F.lit(""))


def weight_of(metadata: Column) -> Column:
    """Weight in a JSON object: 1.0 where absent, NULL where the JSON or the number is broken."""
    raw = F.from_json(metadata, "weight string, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    absent = raw["weight"].isNull() & ~metadata.rlike(r'"weight"\s*:')
    return F.when(
        raw["_bad"].isNull() & F.trim(metadata).startswith("{"),
        F.when(absent, F.lit(1.0)).otherwise(raw["weight"].try_cast("double")),
    )


def with_triple(rows: DataFrame) -> DataFrame:
    """Adds predicate, source, target and weight, each NULL where the row does not give one."""
    return rows.withColumns(
        {
            "predicate": predicate_of(F.col("relation")),
            "source": clean_concept(F.col("start_uri")),
            "target": clean_concept(F.col("end_uri")),
            "weight": weight_of(F.col("metadata_json")),
        }
    )


def eligible(rows: DataFrame, min_weight: float | Column = 2.0) -> DataFrame:
    """Rows with a mapped relation, two English concepts and a weight of at least min_weight. No shuffle."""
    least = min_weight if isinstance(min_weight, Column) else F.lit(float(min_weight))
    return with_triple(rows).where(
        F.col("predicate").isNotNull()
        & F.col("source").isNotNull()
        & F.col("target").isNotNull()
        & (F.col("weight") >= least)
        & ~F.isnan("weight")
    )


def sampling_score(seed: int | Column, predicate: Column, source: Column, target: Column) -> Column:
    """First 64 bits of SHA-256 of the seeded triple as a fraction of 2**64."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    key = F.concat_ws("|", s.cast("string"), predicate, source, target)
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_sample(triples: DataFrame, coverage_percent: float, seed: int = 42) -> DataFrame:
    """Keeps a triple if its score lies under the coverage; all copies of a triple share one fate."""
    if not 0 < coverage_percent <= 100:
        raise ValueError("coverage percent must be in the range (0, 100]")
    if coverage_percent >= 100:
        return triples
    score = sampling_score(seed, F.col("predicate"), F.col("source"), F.col("target"))
    return triples.where(score < coverage_percent / 100.0)


def dedupe_first(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """First row of each triple by seq: a min_by aggregate, so copies are combined before the shuffle."""
    rest = [c for c in triples.columns if c not in ("predicate", "source", "target")]
    return (
        triples.groupBy("predicate", "source", "target")
        .agg(F.min_by(F.struct(*rest), F.col(seq)).alias("row"))
        .select("predicate", "source", "target", "row.*")
    )


def stv(weight: Column) -> Column:
    return F.format_string("(STV 1.0 %.4f)", F.least(weight / (weight + 0.2), F.lit(0.9999)))


def stable_id(predicate: Column, source: Column, target: Column) -> Column:
    digest = F.substring(F.md5(F.concat_ws("|", predicate, source, target)), 1, 10)
    return F.concat(F.lit("cnet_"), F.lower(predicate), F.lit("_"), digest)


def sentence_of(predicate: Column, source: Column, target: Column, relation: Column) -> Column:
    plain = (F.replace(source, F.lit("_"), F.lit(" ")), F.replace(target, F.lit("_"), F.lit(" ")))
    out = F.when(relation == "/r/HasProperty", F.concat(source, F.lit(" is "), target))
    for name, pattern in SENTENCES.items():
        out = out.when(predicate == name, F.format_string(pattern, *plain))
    return out


def emit(triples: DataFrame) -> DataFrame:
    """Atom line and vector payload of each triple."""
    p, s, t = F.col("predicate"), F.col("source"), F.col("target")
    atom = F.concat(F.lit("(: "), stable_id(p, s, t), F.lit(" ("), F.concat_ws(" ", p, s, t), F.lit(") "), stv(F.col("weight")), F.lit(")"))
    return triples.select(
        p.alias("relation"),
        atom.alias("atom"),
        sentence_of(p, s, t, F.col("relation")).alias("nl"),
        F.array(atom).alias("pln"),
        F.lit("conceptnet").alias("source"),
        F.lit(True).alias("background"),
    )


def export(rows: DataFrame, min_weight: float = 2.0, coverage_percent: float = 100.0, seed: int = 42, seq: str = "seq") -> DataFrame:
    """Atoms and records of raw triples: eligible, sampled, first of each triple, emitted."""
    if seq not in rows.columns:
        rows = rows.withColumn(seq, F.monotonically_increasing_id())
    kept = hash_sample(eligible(rows, min_weight), coverage_percent, seed)
    return emit(dedupe_first(kept.select("predicate", "source", "target", "weight", "relation", seq), seq))


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def manifest(rows: DataFrame, min_weight: float, coverage_percent: float, seed: int, seq: str = "assertion_id") -> DataFrame:
    """One row per source file with the counters of an export, from a single pass and one shuffle of distinct triples."""
    ok = (
        F.col("predicate").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull()
        & (F.col("weight") >= min_weight) & ~F.isnan("weight")
    )
    kept = F.lit(True) if coverage_percent >= 100 else sampling_score(seed, F.col("predicate"), F.col("source"), F.col("target")) < coverage_percent / 100.0
    flagged = with_triple(rows).select(
        "source_file",
        F.coalesce(ok, F.lit(False)).alias("is_eligible"),
        F.coalesce(ok & kept, F.lit(False)).alias("is_sampled"),
        F.when(F.coalesce(ok & kept, F.lit(False)), F.struct("predicate", "source", "target")).alias("triple"),
    )
    per_triple = flagged.groupBy("source_file", "triple").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if("is_eligible").alias("eligible"),
        F.count_if("is_sampled").alias("sampled"),
    )
    return per_triple.groupBy("source_file").agg(
        F.sum("scanned").alias("scanned_rows"),
        F.sum("eligible").alias("eligible_row_count"),
        F.sum("sampled").alias("sampled_row_count"),
        F.count("triple").alias("deduped_atom_count"),
    )
