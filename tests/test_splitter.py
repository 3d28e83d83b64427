from ordina.plans.splitter import Splitter


def test_sizes():
    assert Splitter().chunk_size(0, 4) == 0
    assert Splitter.fixed(100).chunk_size(1000, 4) == 100
    assert Splitter.recursive(7).chunk_size(1000, 4) == 7
    assert Splitter.adaptive(10).chunk_size(1000, 4) == 125
    assert Splitter.adaptive(10).with_target_chunks(2).chunk_size(1000, 4) == 500
    assert Splitter.fixed(0).chunk_size(10, 1) == 1


def test_counts_and_split():
    assert Splitter.fixed(300).num_chunks(1000, 1) == 4
    assert Splitter().num_chunks(0, 8) == 0
    assert Splitter.fixed(100).should_split(400, 4)
    assert not Splitter.fixed(100).should_split(399, 4)


def test_defaults():
    assert Splitter() == Splitter.adaptive(2048)
    assert Splitter.fixed(5).with_min_chunk(9).min_chunk == 9
