"""Each stage against a brute-force version of what it must keep, on its own input; queries against their SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ordina.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"pipeline"}))
def test_query_has_a_row_for_each(spark, name):
    whole = spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
    assert QUERIES[name](spark, SF).count() == whole


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _kept int, dedup int, leak int").withColumn("a.b", F.lit(1))


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "x", 1, 2, 3)


def test_stages_keep_columns_and_edge_rows(spark):
    prose = "Anyone who walks the old harbour road at dusk hears bells, slow and far, from a church that nobody has found."
    rows = [row(1, None), row(2, ""), row(3, prose), row(3, prose), row(4, prose), row(None, "lonely words here"), row(5, "word " * 3000, None), row(6, "x")]
    d = docs_of(spark, rows)
    for name, stage in cp.STAGES[:-1]:
        out, none = stage(spark, d, SF), stage(spark, d.limit(0), SF)
        assert out.columns == d.columns == none.columns and none.isEmpty(), name
        out.collect()
    assert cp.mixing_stage(spark, d, SF).count() > 0 and cp.mixing_stage(spark, d.limit(0), SF).isEmpty()


def test_near_dedup_keeps_one_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [row(9, " ".join(base)), row(2, near), row(5, " ".join(base)), row(7, "a clean text of its own with other words"), row(2, near), row(11, None), row(12, "")]
    got = cp.near_dedup_stage(spark, docs_of(spark, rows), SF)
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 11, 12]


def test_substring_stage_cuts_the_later_passage(spark):
    passage = ". ".join(f"sentence number {i} has its own words {i * 7}" for i in range(12)) + "."
    rows = [row(1, "A first text. " + passage), row(2, "Second text of mine. " + passage), row(3, passage), row(4, "clean")]
    got = {r.doc_id: r for r in cp.substring_stage(spark, docs_of(spark, rows), SF).collect()}
    assert set(got) == {1, 2, 4} and got[1].text == rows[0][1] and got[2].text == "Second text of mine. " and got[2].n_chars == len(got[2].text)


def test_decontamination_drops_leaks_only(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [row(1, "Intro. " + item), row(2, "Nothing of the kind."), row(3, None)]
    assert sorted(r.doc_id for r in cp.decontaminate_stage(spark, docs_of(spark, rows), SF).collect()) == [2, 3]


def test_run_applies_every_stage(spark):
    out = cp.run(spark, SF)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < whole.count() and out.columns == [*whole.columns, "mix"]
    assert out.where(F.col("mix.taken") <= 0).isEmpty()
    times = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mix.epochs").alias("epochs"))
    assert times.where("n <> epochs").isEmpty() and times.where("n > 1").count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "mixing"]
