"""Problem 1: a sample that is the same in every run and layout and only gains records as data arrive.

A Feistel network permutes a fixed domain of identifiers under a seed; an identifier is selected if its permuted
value lies under rate x domain size. The permutation is a bijection, so no two identifiers collide and over a full
domain the sample has exactly rate x size members; it depends on nothing but identifier and seed, so a selected
identifier stays selected whatever else arrives, and a higher rate selects a superset. It is a Column expression of
integer arithmetic: no state, no shuffle, no Python.

Defined cases: NULL identifiers, rates or seeds select nothing; the default domain holds every 64-bit integer, negative
ones as unsigned numbers above the others; identifiers outside a smaller domain select nothing; a rate of 1 or more
selects all identifiers in the domain, one of 0 or less none; repeated identifiers share one fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.collapse import hot_keys
from factloom.operators.triples import with_triple
from factloom.session import materialize

# Multipliers and primes under 2**31 of the round function, and one offset per round.
MULTIPLIERS = (0x45D9F3B, 0x2C1B3C6D, 0x297A2D39)
PRIMES = (2147483647, 2147483629, 2147483587)
OFFSETS = (0x1E3779B9, 0x3C6EF372, 0x5BE0CD19, 0x1F83D9AB, 0x510E527F, 0x6A09E667)
DOMAIN_BITS = 64
LOW31 = (1 << 31) - 1


def _round_key(seed: Column, offset: int) -> Column:
    low = seed.bitwiseAND(F.lit(LOW31)).bitwiseXOR(F.lit(offset))
    return (low * F.lit(MULTIPLIERS[0]) % F.lit(PRIMES[1])).bitwiseXOR(F.shiftrightunsigned(seed, 31).bitwiseAND(F.lit(LOW31)))


def _scramble(right: Column, key: Column, mask: Column) -> Column:
    """Round function of numbers of up to 32 bits: exclusive or and products modulo three primes in turn, all under 2**63.

    It refers to the right half once, so that the expression of all rounds stays small.
    """
    v = right.bitwiseXOR(key) * F.lit(MULTIPLIERS[0]) % F.lit(PRIMES[0])
    v = v.bitwiseXOR(F.lit(OFFSETS[0])) * F.lit(MULTIPLIERS[1]) % F.lit(PRIMES[1])
    v = (v + key) * F.lit(MULTIPLIERS[2]) % F.lit(PRIMES[2])
    return (v * F.lit(MULTIPLIERS[2])).bitwiseAND(mask)


def _halves(ident: Column, seed: Column, domain_bits: int) -> tuple[Column, Column]:
    if domain_bits % 2 or not 4 <= domain_bits <= 64:
        raise ValueError("domain_bits must be even and in 4 .. 64")
    half = domain_bits // 2
    mask = F.lit((1 << half) - 1)
    ident, seed = ident.cast("long"), seed.cast("long")
    left, right = F.shiftrightunsigned(ident, half).bitwiseAND(mask), ident.bitwiseAND(mask)
    for offset in OFFSETS:
        left, right = right, left.bitwiseXOR(_scramble(right, _round_key(seed, offset), mask))
    if domain_bits < 64:
        left = F.when((ident >= 0) & (ident < F.lit(1 << domain_bits)), left)
    return left, right


def permute(ident: Column, seed: Column, domain_bits: int = DOMAIN_BITS) -> Column:
    """The identifier's place under the seed's permutation of 0 .. 2**domain_bits - 1 (of 64 bits: as a signed number);
    NULL outside the domain."""
    left, right = _halves(ident, seed, domain_bits)
    return F.shiftleft(left, domain_bits // 2).bitwiseOR(right)


def selected(ident: Column, rate: Column, seed: Column, domain_bits: int = DOMAIN_BITS) -> Column:
    """True for identifiers in the sample; False for all others, NULLs among them. The bound is rate x domain size,
    whose high half is compared with that of the place, then the low one."""
    left, right = _halves(ident, seed, domain_bits)
    size = 2.0 ** (domain_bits // 2)
    bound = F.least(F.greatest(rate.cast("double"), F.lit(0.0)), F.lit(1.0)) * F.lit(size)
    high = F.floor(bound).cast("long")
    low = ((bound - high) * F.lit(size)).cast("long")
    place = F.struct(left.alias("high"), right.alias("low"))
    return F.coalesce((place < F.struct(high.alias("high"), low.alias("low"))) & left.isNotNull() & rate.isNotNull() & ~F.isnan(rate.cast("double")), F.lit(False))


def sample(rows: DataFrame, ident: str, rate: float, seed: int, domain_bits: int = DOMAIN_BITS) -> DataFrame:
    return rows.where(selected(F.col(ident), F.lit(rate), F.lit(seed), domain_bits))


#: Most source files whose settings are broadcast: some 10 MB.
BROADCAST_FILES = 50_000


def _join_by_file(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """rows with the columns of their source file's one row in per_file.

    Few files are broadcast. Of many, those that hold a thousandth of the rows each are, so that no file is one task's,
    and the rows of the others meet theirs in a shuffle.
    """
    per_file = materialize(per_file, "per-file")
    if per_file.count() <= BROADCAST_FILES:
        return rows.join(F.broadcast(per_file), "source_file")
    keyed = rows.select(F.col("source_file").cast("binary").alias("key"), F.xxhash64("assertion_id").alias("id")).where("key is not null")
    hot = materialize(hot_keys(keyed).select(F.col("key").cast("string").alias("source_file")), "hot-files")  # at most MAX_HOT rows
    cold = rows.join(F.broadcast(hot), "source_file", "left_anti").join(per_file, "source_file")
    return cold.unionByName(rows.join(F.broadcast(per_file.join(F.broadcast(hot), "source_file", "left_semi")), "source_file"))


def with_sample_counts(assertions: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows, eligible rows and sampled rows of each source file, setting and load batch.

    settings: distinct source_file, min_weight, coverage_percent, sample_seed; a handful per source file. Its
    settings are gathered into one array per file, so that a row of a file meets one row. Counting combines before its
    shuffle.
    """
    per_file = settings.groupBy("source_file").agg(F.collect_set(F.struct("min_weight", "coverage_percent", "sample_seed")).alias("each"))
    rows = with_triple(assertions).select(
        "source_file",
        "load_batch",
        "assertion_id",
        F.when(F.col("predicate").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull(), F.col("weight")).alias("weight"),
    )
    each = _join_by_file(rows, per_file).select("*", F.explode("each").alias("s")).drop("each")
    is_eligible = F.coalesce(F.col("weight") >= F.col("s.min_weight"), F.lit(False))
    in_sample = is_eligible & selected(F.col("assertion_id"), F.col("s.coverage_percent") / 100.0, F.col("s.sample_seed"))
    return each.groupBy("source_file", "s.min_weight", "s.coverage_percent", "s.sample_seed", "load_batch").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(is_eligible).alias("eligible"), F.count_if(in_sample).alias("sampled")
    )


SERIES = ["source_file", "normalization_version", "min_weight", "coverage_percent", "sample_seed"]


def replayed_exports(manifest: DataFrame, assertions: DataFrame) -> DataFrame:
    """Exports of the manifest with what the Feistel sample of their settings holds at the batches they had scanned.

    An export had scanned the load batches whose rows, counted from the first batch on, fit into its scanned_rows.
    The replayed count is a sum over a set of batches that grows with scanned_rows, so it never falls within a series.
    """
    counts = with_sample_counts(assertions, manifest.select("source_file", "min_weight", "coverage_percent", "sample_seed").distinct())
    w = "over (partition by source_file, min_weight, coverage_percent, sample_seed order by load_batch)"
    upto = counts.select(
        "source_file", "min_weight", "coverage_percent", "sample_seed",
        F.expr(f"sum(scanned) {w}").alias("upto_rows"), F.expr(f"sum(sampled) {w}").alias("upto_sampled"),
    )
    steps = upto.groupBy("source_file", "min_weight", "coverage_percent", "sample_seed").agg(
        F.collect_list(F.struct("upto_rows", "upto_sampled")).alias("steps")  # one entry per load batch
    )
    e, s = manifest.alias("e"), steps.alias("s")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("source_file", "min_weight", "coverage_percent", "sample_seed")]
    held = F.filter("s.steps", lambda x: x["upto_rows"] <= F.col("e.scanned_rows"))
    return e.join(s, same, "left").select("e.*", F.coalesce(F.array_max(F.transform(held, lambda x: x["upto_sampled"])), F.lit(0)).alias("replayed_count"))


def broken_samples(manifest: DataFrame, assertions: DataFrame) -> DataFrame:
    """Neighbouring exports of a series whose recorded counts changed as those of the Feistel sample did not.

    The sample is replayed at both exports; its change decides. Where scanned and eligible rows did not fall, a recorded
    count that fell by more than the replayed one is a case; where both are unchanged, so is every recorded change that
    differs from the replayed one. Exports without a recorded count are left out; ties in exported_at are ordered by
    manifest_id.
    """
    needed = manifest.select("manifest_id", "exported_at", *SERIES, "scanned_rows", "eligible_row_count", "sampled_row_count")
    known = replayed_exports(needed.where(F.col("sampled_row_count").isNotNull()), assertions)
    keep = ["manifest_id", "scanned_rows", "eligible_row_count", "sampled_row_count", "replayed_count"]
    row = F.struct(*keep)
    by = f"over (partition by {', '.join(SERIES)} order by exported_at, manifest_id)"
    pairs = known.select(row.alias("later"), F.expr(f"lag(struct({', '.join(keep)})) {by}").alias("first")).where("first is not null")
    change = lambda c: F.col(f"later.{c}") - F.col(f"first.{c}")
    recorded, replayed = change("sampled_row_count"), change("replayed_count")
    not_fallen = (change("scanned_rows") >= 0) & (change("eligible_row_count") >= 0)
    unchanged = (change("scanned_rows") == 0) & (change("eligible_row_count") == 0)
    broken = (recorded < F.least(replayed, F.lit(0))) | (unchanged & (recorded != replayed))
    return pairs.where(not_fallen & broken).select(F.col("first.manifest_id").alias("first_manifest_id"), F.col("later.manifest_id").alias("later_manifest_id"))


def sampled_assertions(assertions: DataFrame, manifest: DataFrame) -> DataFrame:
    """The sample of each source file under the settings of its latest export: one row per selected assertion.

    An assertion sent more than once counts with its earliest eligible load batch.
    """
    latest = manifest.groupBy("source_file").agg(
        F.max_by(F.struct("min_weight", "coverage_percent", "sample_seed"), F.struct("exported_at", "manifest_id")).alias("s")
    )
    rows = with_triple(assertions).where("predicate is not null and source is not null and target is not null and weight is not null")
    kept = _join_by_file(rows.select("source_file", "assertion_id", "load_batch", "weight"), latest).where(
        (F.col("weight") >= F.col("s.min_weight")) & selected(F.col("assertion_id"), F.col("s.coverage_percent") / 100.0, F.col("s.sample_seed"))
    )
    return kept.groupBy("source_file", "assertion_id").agg(F.min("load_batch").alias("load_batch"))
