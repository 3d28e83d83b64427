"""Numeric workloads: primes, triples, trees, tours, recursions, kernels, grids and bodies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.functions.scalar import gcd, gray, saturating_add
from ordina.operators.combine import neighbours
from ordina.plans.scratch import discard, materialise


def primes(spark: SparkSession, limit: int) -> DataFrame:
    """Primes up to the limit: odd numbers without those that are multiples of an odd number up to the root."""
    root = math.isqrt(max(0, limit))
    odd = spark.range(3, limit + 1, 2).select(F.col("id").alias("n"))
    multiples = spark.range(3, root + 1, 2).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(max(limit, 9)), 2 * F.col("id"))).alias("n")).where(F.col("n") <= limit)
    two = spark.range(2, min(3, limit + 1)).select(F.col("id").alias("n"))
    return two.unionAll(odd.join(multiples, "n", "left_anti"))


def triples(spark: SparkSession, limit: int) -> DataFrame:
    """Primitive Pythagorean triples a < b < limit, c <= limit, by an equi-join on the square of c."""
    n = spark.range(1, limit).select(F.col("id").alias("a"))
    squares = spark.range(1, limit + 1).select(F.col("id").alias("c"), (F.col("id") * F.col("id")).alias("cc"))
    pairs = n.select("a", F.explode(F.sequence(F.col("a") + 1, F.greatest(F.col("a") + 1, F.lit(limit - 1)))).alias("b")).where(F.col("b") < limit)
    return pairs.withColumn("cc", F.col("a") * F.col("a") + F.col("b") * F.col("b")).join(squares, "cc").where(gcd(F.col("a"), F.col("b"), 24) == 1).select("a", "b", "c")


def tree_stats(spark: SparkSession, depth: int) -> DataFrame:
    """Nodes, sum, largest value and height of the heap-numbered tree of that depth, by recursion from the root."""
    return spark.sql(f"""
        WITH RECURSIVE nodes(v, d) AS (SELECT CAST(1 AS BIGINT), 1 UNION ALL SELECT 2 * v + k, d + 1 FROM nodes JOIN (VALUES (0), (1)) AS t(k) WHERE d < {depth})
        SELECT count(*) AS n, coalesce(sum(v), 0) AS total, max(v) AS largest, max(d) AS height FROM nodes""")


def tour_cost(spark: SparkSession, n: int = 5) -> DataFrame:
    """Cheapest round trip over n <= 12 cities at distance |i - j| * 10 + (i + j) % 5, by recursion over visited sets."""
    if not 1 < n <= 12:
        raise ValueError("2 to 12 cities")
    return spark.sql(f"""
        WITH RECURSIVE city(c) AS (SELECT CAST(id AS INT) FROM range({n})),
        tour(at, seen, cost, k) AS (SELECT 0, 1, 0, 1 UNION ALL
            SELECT c, seen | CAST(shiftleft(1, c) AS INT), cost + abs(at - c) * 10 + (at + c) % 5, k + 1 FROM tour JOIN city ON (seen & shiftleft(1, c)) = 0 WHERE k < {n})
        SELECT min(cost + at * 10 + at % 5) AS cost FROM tour WHERE k = {n}""")


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    return spark.sql(f"WITH RECURSIVE f(k, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < {n}) SELECT k, a AS fib FROM f")


def factorials(spark: SparkSession, n: int) -> DataFrame:
    """k! for k up to n <= 33, which decimals hold; see wrapped_factorials for more."""
    if n > 33:
        raise ValueError("decimals are exact up to 33!")
    k = F.col("id").cast("int")
    fact = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(38,0)")).cast("decimal(38,0)"))
    return spark.range(n + 1).select(k.alias("k"), fact.alias("fact"))


def wrapped_factorials(spark: SparkSession, n: int) -> DataFrame:
    """k! modulo 2**128 as 32 hex digits, for k up to n < 2**31: four limbs of 32 bits, multiplied in a fold."""
    names, mask = ("a", "b", "c", "d"), F.lit(0xFFFFFFFF)  # the lowest first

    def times(limbs: Column, x: Column) -> Column:
        out, carry = [], F.lit(0).cast("bigint")
        for c in names:
            product = limbs[c] * x + carry
            out.append(product.bitwiseAND(mask).alias(c))
            carry = F.shiftrightunsigned(product, 32)
        return F.struct(*out)

    one = F.struct(F.lit(1).cast("bigint").alias("a"), *(F.lit(0).cast("bigint").alias(c) for c in names[1:]))
    limbs = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("id"), F.lit(1))), one, times)
    digits = F.concat(*(F.lpad(F.hex(F.col("limbs")[c]), 8, "0") for c in reversed(names)))
    return spark.range(n + 1).select(F.col("id").alias("k"), limbs.alias("limbs")).select("k", digits.alias("fact"))


def monte_carlo_pi(spark: SparkSession, samples: int, chunks: int = 64) -> DataFrame:
    """Estimate of pi from points that are hashes of (chunk seed, number), so reruns agree."""
    u = lambda k: F.pmod(F.xxhash64(F.col("id") % chunks * 12345 + 67890, F.col("id"), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(samples).select(u(1).alias("x"), u(2).alias("y")).agg((4.0 * F.count_if(F.col("x") ** 2 + F.col("y") ** 2 <= 1) / F.count(F.lit(1))).alias("pi"))


def kernel_f32(x: Column) -> Column:
    """sqrt(x * x + 1) * sin(x * 0.001), rounded to single precision."""
    x = x.cast("double")
    return (F.sqrt(x * x + 1) * F.sin(x * 0.001)).cast("float")


def double_clamp(v: Column, double: bool, clamp: bool) -> Column:
    """Stages that run-time flags switch on."""
    v = 2 * v if double else v
    return F.greatest(v, F.lit(0)) if clamp else v


def test_image(spark: SparkSession, width: int, height: int) -> DataFrame:
    """x, y and a gradient."""
    x, y = F.col("id") % width, F.floor(F.col("id") / width)
    return spark.range(width * height).select(x.cast("int").alias("x"), y.cast("int").alias("y"), F.floor(255 * x / width).cast("int").alias("r"), F.floor(255 * y / height).cast("int").alias("g"), F.floor(128 * (x + y) / (width + height)).cast("int").alias("b"))


def image_kernels(px: DataFrame) -> DataFrame:
    """Gray, sepia, brightened and inverted channels of each pixel, and whether it is bright."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    tone = lambda i, j, k: F.least(F.lit(255), F.expr(f"(r * {i} + g * {j} + b * {k}) div 1000").cast("int"))
    return px.select(
        "x", "y", gray(r, g, b).alias("gray"), tone(393, 769, 189).alias("sepia_r"), tone(349, 686, 168).alias("sepia_g"), tone(272, 534, 131).alias("sepia_b"),
        saturating_add(r, 30).alias("bright_r"), (255 - r).alias("inverted_r"), (F.expr("(r + g + b) div 3") > 128).alias("is_bright"),
    )


def life(cells: DataFrame, rows: int, cols: int, steps: int) -> DataFrame:
    """Conway's game on a wrapped grid: live cells (r, c) after some steps. Each step is written, so plans stay short."""
    now = materialise(cells.select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c")).distinct(), "life")
    for _ in range(steps):
        n = neighbours(now, rows, cols).select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "n")
        alive = now.withColumn("alive", F.lit(True))
        then = materialise(n.join(alive, ["r", "c"], "left").where("n = 3 or (n = 2 and alive)").select("r", "c"), "life")
        discard(now)
        now = then
    return now


#: Fixed values of the body simulation: the kick of a step is KICK * mass.
KICK, STEP = 0.001 / 1e10, 0.01


def kick_drift(bodies: DataFrame, steps: int, dt: float = STEP) -> DataFrame:
    """Steps of a kick of each velocity and a drift by it. A body depends on none but itself, so the steps add up in one pass."""
    kick = F.lit(KICK) * F.col("mass")
    moved = {p: F.col(p) + dt * (steps * F.col("v" + p) + kick * (steps * (steps + 1) / 2)) for p in ("x", "y", "z")}
    return bodies.withColumns(moved | {"v" + p: F.col("v" + p) + steps * kick for p in ("x", "y", "z")})


def kinetic_energy(bodies: DataFrame) -> DataFrame:
    return bodies.agg(F.sum(0.5 * F.col("mass") * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("energy"))


def seeded_integers(spark: SparkSession, n: int, seed: int = 12345) -> DataFrame:
    """n integers of 31 bits by position, by two steps of a linear congruence."""
    step = lambda x: (x * F.lit(1103515245).cast("bigint") + 12345) % F.lit(1 << 31)
    return spark.range(n).select(F.col("id").alias("pos"), step(step((F.col("id") * 2654435 + seed) % F.lit(1 << 31))).alias("v"))
