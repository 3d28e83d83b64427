"""Components against brute force over all pairs, hot groups, edge rows and star rounds."""

import random
from itertools import combinations

import pytest

from ordina.llm import near_dedup
from ordina.llm.near_dedup import MinHash, connected_components, near_duplicates, shingle_set


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(rows[a][0]), root(rows[b][0])
            parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def run(spark, rows, cfg):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(df, cfg=cfg).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


def variants(rng, n, base_words=60, changes=3):
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    rng = random.Random(words)
    texts = [t for g in range(8) for t in variants(rng, 10, 40 + 10 * g, 1 + g % 4)] + [" ".join(f"u{rng.randrange(3000)}" for _ in range(50)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900, "One"), (901, "one"), (902, ""), (903, None), (904, " \t\n"), (905, "one two"), (906, "One\x0btwo"), (907, "É one two"), (908, "é one two"), (None, texts[0]), (None, None), (5, texts[5])]
    assert run(spark, rows, MinHash(words=words, percent=percent)) == brute(rows, words, percent)


@pytest.mark.parametrize("tile", [10_000, 16 << 20])
def test_hot_group_of_near_copies(spark, monkeypatch, tile):
    """One group holds most rows; its members are similar to the hub more than to each other."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(400):
        w = base[:]
        at = rng.randrange(110)
        w[at : at + 4] = [f"c{i}_{k}" for k in range(4)]
        rows.append((i, " ".join(w)))
    assert run(spark, rows, MinHash(words=3, percent=85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("tile", [6_000, 16 << 20])
def test_bucket_of_many_components(spark, monkeypatch, tile):
    """Members of a hot bucket lie around the threshold, so that it holds many components and links far from its smallest id."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = base[:]
        for at in rng.sample(range(40, 90), rng.randrange(1, 4)):
            w[at] = f"y{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 3, 85)
    assert 5 < len({r[2] for r in want}) < 155 and run(spark, rows, MinHash(words=3, percent=85)) == want


def test_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = run(spark, [(1, a), (2, b), (7, a), (7, b)], MinHash())
    assert {r[2] for r in got} == {1}


def test_empty_table_and_other_columns(spark):
    assert run(spark, [], MinHash()) == []
    df = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, None)], "doc_id bigint, text string, component_id int, sig string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_bands_meet_the_promised_miss():
    for percent in (60, 80, 85, 95):
        c = MinHash(percent=percent)
        assert (1 - (percent / 100) ** c.rows) ** c.bands <= c.miss
    assert (MinHash(percent=85).rows, MinHash().rows) == (5, 4)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 180)}}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


def test_shingles_of_long_text_are_all_counted():
    assert len(shingle_set(" ".join(str(i) for i in range(50_000)).encode(), 3)) == 49_998
