import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordina.llm import substring_dedup
from ordina.llm.substring_dedup import ENDS, dedup_substrings


def brute(rows, least):
    """Sequential version: documents in order of (id, position), with strings instead of digests."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        cut = text
        for e in ENDS:
            cut = cut.replace(e + " ", e + "\n")
        at, own = 0, []
        for u in cut.split("\n"):
            if u.split():
                own.append((at, " ".join(u.lower().split())))
            at += len(u) + 1
        late = []
        for _, u in own:
            late.append(u in seen)
            seen.add(u)
        starts = [s for s, _ in own] + [len(text)]
        kept, i = text[: starts[0]] if own else text, 0
        while i < len(own):
            j = i
            while j < len(own) and late[j] == late[i]:
                j += 1
            if not (late[i] and sum(len(u.split()) for _, u in own[i:j]) >= least):
                kept += text[starts[i] : starts[j]]
            i = j
        out[doc] = kept
    return out


def words(rng, n):
    return " ".join(f"w{rng.randrange(100000)}" + (rng.choice(ENDS) if rng.random() < 0.15 else "") for _ in range(n))


@pytest.mark.parametrize("memo", [0, 5, 10_000])
def test_equals_brute_force(spark, monkeypatch, memo):
    monkeypatch.setattr(substring_dedup, "MEMO", memo)
    rng = random.Random(4)
    shared = [words(rng, 60) for _ in range(4)]
    rows = [(i, words(rng, rng.randrange(40)) + rng.choice([" ", "\n", ". "]) + rng.choice(shared) + rng.choice([" ", "\n"]) + words(rng, 10)) for i in range(60)]
    rows += [(100 + i, "the same line, again and again. It has few words.") for i in range(50)]
    want = brute(rows, 25)
    rng.shuffle(rows)
    got = {r.doc_id: r.text for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == want


def test_passage_inside_lines_is_cut_and_offsets_hold(spark):
    rng = random.Random(5)
    passage = words(rng, 55) + "."
    rows = [(1, "First text. " + passage), (2, "Table | cells | " + passage + " And more."), (3, "Clean text that nobody repeats, not even in part.")]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    (span,) = got[2].dedup.spans
    assert rows[1][1][: span.start] + rows[1][1][span.end :] == got[2].text and len(got[2].text) < 0.5 * len(rows[1][1])


def test_edge_rows(spark):
    long_ = "word " * 30
    rows = [(1, None), (2, ""), (3, " \n "), (4, long_), (5, long_), (None, long_), (6, "É" * 3 + ", " + long_), (4, long_)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("dedup", F.lit(1)).withColumn("_units", F.lit("u")).withColumn("a.b", F.lit(1))
    got = dedup_substrings(df).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "dedup", "_units", "a.b", "dedup_"} and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.dedup_.n_removed))
    assert by[1] == [(None, 0)] and by[2] == [("", 0)] and by[3] == [(" \n ", 0)] and by[4] == [(long_, 0)] * 2
    assert by[5] == [("", 1)] and by[None] == [("", 1)] and by[6] == [("ÉÉÉ, ", 1)]


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(6)
    text = words(rng, 200_000)
    got = dedup_substrings(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, len(r.text)) for r in got) == [(1, len(text)), (2, 0)]
    assert dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()


def test_whole_lines_go_however_short(spark):
    rows = [(1, "Share this page\nOne text, of its own\nand end"), (4, " \n"), (5, ""), (2, "share  this page\nAnother text, and end\nShare this page\nof its own"), (3, "One text, of its own\nmore of it, share this page")]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), whole_lines=True).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == "Another text, and end\nof its own" and got[2].dedup.n_removed == 2
    assert got[3].text == "more of it, share this page" and [(s.start, s.end) for s in got[3].dedup.spans] == [(0, 21)]


def test_texts_are_cut_once_where_the_outcome_is_filtered_on(spark):
    rows = [(1, "the same line"), (2, "the same line"), (3, "another")]
    cut = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), whole_lines=True)
    left = cut.where(~((F.col("dedup.n_removed") > 0) & (F.trim("text") == ""))).select("doc_id", "text", "dedup.n_removed")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"ArrowEvalPython \[.*?\], \[(pythonUDF\d+#\d+)\]", plan))) == 1, plan
    assert sorted(map(tuple, left.collect())) == [(1, "the same line", 0), (3, "another", 0)]


@pytest.mark.parametrize("part", [1, 7])
def test_part_has_no_effect(spark, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART", part)
    rows = [(i, f"line {i % 5}\nits own {i}") for i in range(40)] + [(None, None), (50, "")]
    run = substring_dedup._remover(25)
    got = {r.doc_id: r.text for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), whole_lines=True).collect()}
    assert got == {i: t if i is None or i < 5 or i == 50 else f"its own {i}" for i, t in rows}
    assert len(run(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))) == 0
