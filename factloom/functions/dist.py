"""Value distributions as arrays of weighted particles."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTICLES = 64


def point_mass(x: Column) -> Column:
    return F.array(F.struct(x.cast("double").alias("x"), F.lit(1.0).alias("w")))


def from_normal(mu: Column, sigma: Column, n: int = 16) -> Column:
    """Equally weighted quantiles of a normal distribution: the same particles in every run."""
    z = [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]
    return F.array(*[F.struct((mu + sigma * v).cast("double").alias("x"), F.lit(1.0 / n).alias("w")) for v in z])


def normalised(particles: Column) -> Column:
    total = F.aggregate(particles, F.lit(0.0), lambda acc, p: acc + p["w"])
    return F.transform(particles, lambda p: F.struct(p["x"].alias("x"), (p["w"] / total).alias("w")))


def from_pairs(xs: Column, ws: Column) -> Column:
    return normalised(F.zip_with(xs, ws, lambda x, w: F.struct(x.cast("double").alias("x"), w.cast("double").alias("w"))))


def map_dist(particles: Column, f) -> Column:
    return F.transform(particles, lambda p: F.struct(f(p["x"]).cast("double").alias("x"), p["w"].alias("w")))


def map2_dist(a: Column, b: Column, f) -> Column:
    """Every pair of particles; weights multiply. Inputs of PARTICLES particles keep the result bounded."""
    pairs = F.transform(a, lambda p: F.transform(b, lambda q: F.struct(f(p["x"], q["x"]).cast("double").alias("x"), (p["w"] * q["w"]).alias("w"))))
    return F.flatten(pairs)


def reduced(particles: Column, n: int = PARTICLES) -> Column:
    """At most n particles: neighbours in order of x are merged into their weighted mean."""
    ordered = F.array_sort(particles)
    step = F.ceil(F.size(particles) / n).cast("int")

    def merged(i: Column) -> Column:
        part = F.slice(ordered, i * step + 1, step)
        w = F.aggregate(part, F.lit(0.0), lambda acc, p: acc + p["w"])
        return F.struct((F.aggregate(part, F.lit(0.0), lambda acc, p: acc + p["x"] * p["w"]) / w).alias("x"), w.alias("w"))

    groups = F.ceil(F.size(particles) / step).cast("int")
    return F.when(F.size(particles) <= n, particles).otherwise(F.transform(F.sequence(F.lit(0), groups - 1), merged))


def greater_than(particles: Column, bound: Column) -> Column:
    return F.aggregate(particles, F.lit(0.0), lambda acc, p: acc + F.when(p["x"] > bound, p["w"]).otherwise(0.0))


def greater_than_dist(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, p: acc + p["w"] * F.aggregate(b, F.lit(0.0), lambda acc2, q: acc2 + F.when(p["x"] > q["x"], q["w"]).otherwise(0.0)))


def mean(particles: Column) -> Column:
    return F.aggregate(particles, F.lit(0.0), lambda acc, p: acc + p["x"] * p["w"])


def parse_value(statement: Column) -> Column:
    """Particles of a statement's value distribution (PointMass, ParticleFromNormal, ParticleFromPairs); NULL for others."""
    number = r"([-+0-9.eE]+)"
    found = lambda p, i: F.regexp_extract(statement, p, i).try_cast("double")
    point, normal = rf"\(PointMass\s+{number}\s*\)\s*\)$", rf"\(ParticleFromNormal\s+{number}\s+{number}\s*\)\s*\)$"
    block = F.regexp_extract(statement, r"\(ParticleFromPairs\s+\(((?:\s*\([^()]*\))+)\s*\)\s*\)\s*\)$", 1)
    pairs = F.transform(F.regexp_extract_all(block, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda t: F.split(F.trim(t), r"\s+"))
    xs = F.transform(pairs, lambda p: F.get(p, F.lit(0)).try_cast("double"))
    ws = F.transform(pairs, lambda p: F.get(p, F.lit(1)).try_cast("double"))
    return F.when(statement.rlike(point), point_mass(found(point, 1))).when(statement.rlike(normal), from_normal(found(normal, 1), found(normal, 2))).when(block != "", from_pairs(xs, ws))


#: Named functions for Compute; callers may register more.
COMPUTE = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "min": F.least, "max": F.greatest, "pow": F.pow, "abs": F.abs, "sqrt": F.sqrt, "neg": lambda a: -a}


def compute(name: str, *args: Column) -> Column:
    return COMPUTE[name](*args)
