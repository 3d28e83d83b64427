import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordina.functions.scalar import count_class, gcd, nth_field, parse_double, ratio, tokens
from ordina.sources import files
from ordina.workloads import logs, numeric, text


def test_primes(spark):
    assert [r.n for r in numeric.primes(spark, 30).orderBy("n").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert numeric.primes(spark, 1).isEmpty() and numeric.primes(spark, 2).count() == 1
    assert numeric.primes(spark, 100_000).count() == 9592


def test_triples(spark):
    got = {tuple(r) for r in numeric.triples(spark, 50).collect()}
    want = {(a, b, int(math.hypot(a, b))) for a in range(1, 50) for b in range(a + 1, 50) if math.isqrt(a * a + b * b) ** 2 == a * a + b * b <= 2500 and math.gcd(a, b) == 1}
    assert got == want


def test_recursions(spark):
    assert numeric.tour_cost(spark).first()[0] == 85
    assert tuple(numeric.tree_stats(spark, 4).first()) == (15, 120, 15, 4)
    assert [r.fib for r in numeric.fibonacci(spark, 10).orderBy("k").collect()] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    assert int(numeric.factorials(spark, 33).where("k = 33").first().fact) == math.factorial(33)
    with pytest.raises(ValueError):
        numeric.factorials(spark, 34)


def test_pi_and_life(spark):
    assert abs(numeric.monte_carlo_pi(spark, 200_000).first()[0] - math.pi) < 0.02
    blinker = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "r int, c int")
    assert {tuple(r) for r in numeric.life(blinker, 5, 5, 1).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_logs(spark):
    df = logs.generate(spark, 5000)
    want = [(i * 2654435761) for i in range(5000)]
    got = df.orderBy("pos").collect()
    assert [r.user_id for r in got] == [s % 100_000 for s in want] and [r.message_hash for r in got] == [s % 2**32 for s in want]
    c = logs.counts(df).first()
    assert c.slow == sum(s % 2_000_000 + 1000 > 1_000_000 for s in want)
    assert logs.flagged(df, 100).first()[0] == 100


def test_scalars(spark):
    df = spark.createDataFrame([("1,2.5,x", 12, 18), ("1,bad", 7, 0), ("", 5, 5)], "s string, a int, b int")
    got = df.select(parse_double(nth_field(F.col("s"), 1)).alias("v"), gcd(F.col("a"), F.col("b")).alias("g"), count_class(F.col("s"), "[0-9]").alias("d"), ratio(F.col("a"), F.col("b")).alias("r"), tokens(F.col("s")).alias("t")).collect()
    assert [r.v for r in got] == [2.5, None, None] and [r.g for r in got] == [6, 7, 5] and [r.d for r in got] == [3, 1, 0]
    assert [r.r for r in got] == [pytest.approx(2 / 3), 0.0, 1.0] and got[0].t == ["1", "2", "5", "x"]


def test_word_count(spark):
    df = spark.createDataFrame([("a b a",), ("B-b a",), (None,)], "t string")
    assert {r.word: r.n for r in text.word_counts(df, "t").collect()} == {"a": 3, "b": 2, "B": 1}
    assert [r.word for r in text.top_words(text.word_counts(df, "t"), 2).collect()] == ["a", "b"]
    assert text.byte_stats(spark.createDataFrame([], "l string"), "l").first().fields == 1


def test_ppm(spark, tmp_path):
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(-1, 3)
    data = files.format_ppm(3, 2, rgb)
    assert files.parse_ppm(data.replace(b"P6\n", b"P6\n# made by hand\n"))[:2] == (3, 2)
    for bad in (data[:-1], data.replace(b"255", b"127"), b"P5\n1 1\n255\n0"):
        with pytest.raises(ValueError):
            files.parse_ppm(bad)
    (tmp_path / "a.ppm").write_bytes(data)
    got = files.read_ppm(spark, str(tmp_path / "a.ppm")).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b) for r in got] == [tuple(int(v) for v in p) for p in rgb]


def test_csv(spark, tmp_path):
    made = files.generate_csv_rows(spark, 100)
    files.write_csv(made, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, made.collect()))
    (tmp_path / "x.csv").write_text("id,measurement,category,description,is_active\n1,oops,a,b,1\n\n2,3.5,a,b,0\n")
    assert [r.measurement for r in files.read_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()] == [None, 3.5]
