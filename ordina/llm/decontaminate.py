"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Every window of ``width`` consecutive words of a test item is a pattern.  A text
is normalised byte for byte, so offsets carry over, and scanned once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import fresh, materialise, named, row_key

#: A-Z become a-z; ASCII digits, a-z and all bytes of other characters stay; the rest separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Pattern characters in one automaton (some 100 bytes of memory each at most); larger benchmarks take a pass for each block.
BLOCK_CHARS = 2_000_000

_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_TYPE = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"


def item_windows(text: bytes | None, width: int) -> set[tuple[str, int]]:
    """Patterns with their number of words: each window, or all words if there are fewer."""
    words = text.translate(NORMAL).split() if text else []
    n = min(width, len(words))
    return {(" " + b" ".join(words[i : i + n]).decode("latin-1") + " ", n) for i in range(len(words) - n + 1)} if n else set()


def pattern_blocks(items: Iterator[tuple[str | None, bytes | None]], width: int, limit: int) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """Pattern -> (words, item ids), in blocks of about ``limit`` characters."""
    block: dict[str, tuple[int, list[str]]] = {}
    size = 0
    for item, text in items:
        for pattern, n in sorted(item_windows(text, width)):
            if pattern not in block:
                block[pattern] = (n, [])
                size += len(pattern)
            if (name := item or "") not in block[pattern][1]:
                block[pattern][1].append(name)
        if size > limit:
            yield block
            block, size = {}, 0
    yield block


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(token: str, shared: Broadcast) -> ahocorasick.Automaton | None:
    """The worker's automaton for a block, built once; the one of another block goes."""
    if token not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for pattern, value in shared.value.items():
            a.add_word(pattern, value)
        a.make_automaton()
        _built[token] = a
    return _built[token] if shared.value else None


def scan(text: bytes | None, automaton: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, indices of the words hit, and items hit."""
    words = text.translate(NORMAL).split() if text else []
    if not words or automaton is None:
        return len(words), np.empty(0, np.int64), set()
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return len(words), np.empty(0, np.int64), set()
    blank = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(blank, [end for end, _ in found]) - 1  # the word before the blank that ends the match
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, last + 1, -1)
    np.add.at(cover, last + 1 - [n for _, (n, _) in found], 1)
    return len(words), np.flatnonzero(np.cumsum(cover)[:-1] > 0), {i for _, (_, items) in found for i in items}


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code point ranges of runs of hit words in the original text."""
    flat = np.frombuffer(text.translate(NORMAL), np.uint8)
    inside = np.concatenate([[False], flat != 32, [False]])  # bytes.split() also cuts at nothing but the blanks that NORMAL leaves
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # bytes before -> code points before
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": int(point[starts[r[0]]]), "end": int(point[ends[r[-1]]])} for r in runs]


def _scanner(shared: Broadcast) -> Callable:
    token = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        automaton, out = _automaton(token, shared), []
        for t in texts:
            text = t.as_py()
            n, hit, items = scan(text, automaton)
            out.append({"n_words": n, "n_hit": len(hit), "items": sorted(items), "spans": _spans(text, hit) if len(hit) else []})
        return pa.array(out, _KIND)

    return run


def _merge(n_words: pa.Array, items: pa.Array, spans: pa.Array, texts: pa.Array) -> pa.Array:
    """What several blocks found in one text, as if one automaton had."""
    out = []
    for n, names, ranges, t in zip(n_words.to_pylist(), items.to_pylist(), spans.to_pylist(), texts, strict=True):
        joined: list[dict] = []
        text = t.as_py() or b""
        for s in sorted((s for block in ranges or [] for s in block), key=lambda s: (s["start"], s["end"])):
            if joined and s["start"] <= joined[-1]["end"]:
                joined[-1]["end"] = max(joined[-1]["end"], s["end"])
            else:
                joined.append(dict(s))
        plain = text.decode("utf-8", "replace")
        hit = sum(len(plain[s["start"] : s["end"]].encode().translate(NORMAL).split()) for s in joined)
        out.append({"n_words": n, "n_hit": hit, "items": sorted({i for block in names or [] for i in block}), "spans": joined})
    return pa.array(out, _KIND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, outcome: str = "leak", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs with a struct column ``outcome``: n_words, n_hit, items (ids as sorted strings) and spans.

    A document word inside an occurrence of an item's window of ``width`` words is
    hit; an item of fewer words is one window, one without words none.  spans are
    code point ranges of the original text.  A null or empty text has no words; a
    null item id counts as ''.  Items of equal id are one item.  Repeated rows are
    judged alike.  Other columns pass through; the outcome column gets underscores
    appended if its name is taken.

    The patterns are broadcast in blocks of ``block_chars`` characters: one block
    is the usual case and needs no shuffle; beyond it, each block is a pass of its
    own and what the passes hit is merged by row.
    """
    spark = docs.sparkSession
    (name,) = fresh(docs.columns, outcome)
    rows = benchmark.select(named(item_col).cast("string").alias("i"), named(item_text).cast("binary").alias("t"))
    blocks = pattern_blocks(((r.i, bytes(r.t) if r.t is not None else None) for r in rows.toLocalIterator()), width, block_chars)
    first = next(blocks)
    text = named(text_col).cast("binary")

    def found(block: dict) -> DataFrame:
        return docs.withColumn(name, F.arrow_udf(_scanner(spark.sparkContext.broadcast(block)), _TYPE)(text))

    second = next(blocks, None)
    if not second:
        return found(first)
    key, i = fresh([*docs.columns, name], "_key", "_id")
    parts = None
    for block in (first, second, *blocks):
        hits = found(block).where(F.col(name)["n_hit"] > 0)
        part = materialise(hits.select(named(id_col).alias(i), row_key(id_col, text_col).alias(key), F.col(name)["items"].alias("items"), F.col(name)["spans"].alias("spans")).distinct(), "leaks")
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy(i, key).agg(F.collect_list("items").alias("_items"), F.collect_list("spans").alias("_spans"))
    base = found({}).withColumn(key, row_key(id_col, text_col)).alias("d")
    both = base.join(merged.alias("m"), F.col(f"d.{key}").eqNullSafe(F.col(f"m.{key}")) & named(id_col, "d").eqNullSafe(F.col(f"m.{i}")), "left")
    whole = F.arrow_udf(_merge, _TYPE)(F.col(f"d.{name}")["n_words"], F.col("m._items"), F.col("m._spans"), named(text_col, "d").cast("binary"))
    return both.select(*(named(c, "d") for c in docs.columns), whole.alias(name))


def items_digest(items: list[str]) -> str:
    """What the query's items_sha256 is, in Python."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
