import random
import re

import pytest
from pyspark.sql import functions as F

from ordina.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, width):
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        q = norm(t)
        n = min(width, len(q))
        for i in range(len(q) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == q[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def make(rng):
    vocab = ["a", "bee", "Çé", "d4", "e", "F", "ggg"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, ""), (51, None), (None, text(12)), (3, text(11)), (60, "Çé")]
    docs = [(i, text(rng.randrange(60)) + (rng.choice(items)[1] or "") + " " + text(5)) for i in range(50)] + [(90, None), (91, ""), (92, "!?"), (None, items[2][1]), (7, "a a"), (7, "a a")]
    return items, docs


@pytest.mark.parametrize("width", [2, 10])
@pytest.mark.parametrize("chars", [2_000_000, 150])
def test_equals_brute_force(spark, width, chars):
    items, docs = make(random.Random(width))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("leak", F.lit("taken"))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_contamination(d, b, width=width, block_chars=chars).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text, r.leak_.n_words, r.leak_.n_hit, r.leak_["items"]) for r in got), key=key) == sorted(((i, t, *brute(t, items, width)) for i, t in docs), key=key)
    assert all(r.leak == "taken" for r in got)


def test_spans_map_to_the_original(spark):
    q = "One two three four five six seven eight nine TEN"
    text = "Ünïcode — before; one TWO three, four five\nsix seven eight nine ten! after"
    d, b = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(1, q)], "item_id bigint, text string")
    (span,) = find_contamination(d, b).first().leak.spans
    assert text[span.start : span.end] == "one TWO three, four five\nsix seven eight nine ten"


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "x y")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    r = find_contamination(d, b).first().leak
    assert (r.n_words, r.n_hit, r["items"]) == (2, 0, [])
    assert find_contamination(d.limit(0), b).isEmpty()
