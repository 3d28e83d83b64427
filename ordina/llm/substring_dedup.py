"""Substring dedup by hashing normalised units of lines.

A unit is a line or, within a line, a clause: a line is also cut after sentence
and clause punctuation that a space follows, so a passage copied into the middle
of another line is still found.  Digests are grouped over the whole corpus; the
earliest ranked occurrence of each stays.  A document loses a run of consecutive
repeated units if the run has at least ``min_words`` words; shorter runs of
repeated units stay.  With ``whole_lines`` a whole line that occurs as a line
earlier goes however short it is, and the words count for parts of lines alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import fresh, named, row_key

#: What ends a unit when a space follows.
ENDS = (".", "!", "?", ",", ";", ":")
#: Digests that a task remembers before it starts anew, in order to send a frequent one seldom; a bound on memory, without effect on results.
MEMO = 200_000
#: Rows that are held as Python objects at once; a bound on memory, without effect on results.
PART = 512
#: Added to the number of a line's first unit where the line as a whole is meant.
LINE = 1 << 30


def units(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """Start offset and normalised words of each unit that has words."""
    cut = text
    for end in ENDS:
        cut = cut.replace(end + " ", end + "\n")
    start = 0
    for unit in cut.split("\n"):
        if words := unit.lower().encode().split():
            yield start, words
        start += len(unit) + 1


def lines(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """First unit and end of each line with words, from the units' starts: the first unit with words is at the line's start."""
    first = [i for i, s in enumerate(starts) if s == 0 or text[s - 1] == "\n"]
    return zip(first, [*first[1:], len(starts)], strict=False)


_UNITS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("unit", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("later", pa.bool_())])


def _digests(whole_lines: bool) -> Callable:
    """A row for each unit, and for each line if asked for; ``later`` marks one of which this task has sent an earlier occurrence."""

    def digests(text: str) -> Iterator[tuple[int, bytes]]:
        own = list(units(text))
        for i, (_, words) in enumerate(own):
            yield i, xxhash.xxh3_128_digest(b" ".join(words))
        for i, j in lines(text, [s for s, _ in own]) if whole_lines else ():
            yield LINE + i, xxhash.xxh3_128_digest(b" ".join(w for _, words in own[i:j] for w in words), seed=1)  # never met by a unit's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        for batch in batches:
            for part in range(0, batch.num_rows, PART):
                some = batch.slice(part, PART)
                ids, rows, unit, digest, later = [], [], [], [], []
                for doc, row, text in zip(some.column("id").to_pylist(), some.column("row").to_pylist(), some.column("text").to_pylist(), strict=True):
                    for i, d in digests(text or ""):
                        rank = (doc is None, doc or 0, row, i)
                        known = first.get(d)
                        seen = known is not None and known < rank
                        if not seen:
                            if known is None and len(first) >= MEMO:
                                first.clear()  # a frequent one is soon known again
                            first[d] = rank
                        ids.append(doc)
                        rows.append(row)
                        unit.append(i)
                        digest.append(d)
                        later.append(seen)
                halves = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digest), [None, pa.py_buffer(b"".join(digest))])
                words = pa.Array.from_buffers(pa.int64(), 2 * len(digest), [None, halves.buffers()[1]])
                even = pa.array(range(0, 2 * len(digest), 2), pa.int64())
                k1, k2 = words.take(even), words.take(pa.array(range(1, 2 * len(digest), 2), pa.int64()))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(unit, pa.int32()), k1, k2, pa.array(later, pa.bool_())], schema=_UNITS)

    return run


def repeated_units(docs: DataFrame, id_col: str, text_col: str, whole_lines: bool = False) -> DataFrame:
    """id, row and the numbers of the document's units that occur earlier in the corpus.

    Ranked by id (nulls last), then row digest, then position.  With ``whole_lines``
    also LINE plus its first unit's number for each line that occurs earlier as one.
    """
    src = docs.select(named(id_col).cast("bigint").alias("id"), row_key(id_col, text_col).alias("row"), named(text_col).alias("text"))
    found = src.mapInArrow(_digests(whole_lines), "id bigint, row bigint, unit int, k1 bigint, k2 bigint, later boolean")
    # What a task already knows to be later only passes through, dealt by its own place: a frequent unit arrives once a task and memory.
    key = [F.when(F.col("later"), F.xxhash64("id", "row", "unit")).otherwise(F.col("k1")).alias("k1"), F.when(F.col("later"), F.lit(0)).otherwise(F.col("k2")).alias("k2")]
    dealt = found.select("id", "row", "unit", "later", *key)
    order = Window.partitionBy("k1", "k2", "later").orderBy(F.col("id").asc_nulls_last(), "row", "unit")
    late = dealt.withColumn("rank", F.rank().over(order)).where("later or rank > 1")
    return late.groupBy("id", "row").agg(F.collect_set("unit").alias("units"))


def _remover(min_words: int) -> Callable:
    kind = pa.struct([("text", pa.string()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def one(text: str | None, late: list[int] | None) -> dict:
        if text is None:
            return {"text": None, "n_units": 0, "n_removed": 0, "spans": []}
        own = [(s, len(w)) for s, w in units(text)]
        if not late:
            return {"text": text, "n_units": len(own), "n_removed": 0, "spans": []}
        starts = [s for s, _ in own] + [len(text)]
        late, spans, gone, i = set(late), [], set(), 0
        while i < len(own):
            j = i
            while j < len(own) and j in late:
                j += 1
            if j > i and sum(n for _, n in own[i:j]) >= min_words:
                gone.update(range(i, j))
            i = max(j, i + 1)
        for i, j in lines(text, starts[:-1]):
            if LINE + i in late:
                gone.update(range(i, j))
        for i in sorted(gone):
            if spans and i - 1 in gone:
                spans[-1]["end"] = starts[i + 1]
            else:
                spans.append({"start": starts[i], "end": starts[i + 1]})
        kept, at = [], 0
        for s in spans:
            kept.append(text[at : s["start"]])
            at = s["end"]
        return {"text": "".join(kept) + text[at:], "n_units": len(own), "n_removed": len(gone), "spans": spans}

    def run(text: pa.Array, late: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(text), PART):
            parts.append(pa.array([one(t.as_py(), x.as_py()) for t, x in zip(text.slice(at, PART), late.slice(at, PART), strict=True)], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, outcome: str = "dedup", whole_lines: bool = False) -> DataFrame:
    """The rows of docs with repeated passages cut out, and a struct column ``outcome``.

    ``outcome`` has n_units, n_removed and spans, the removed ranges as offsets
    (code points, end exclusive) into the original text.  A span ends where the
    next unit with words starts, so what separates units goes with them.  No row
    is dropped: a document all of which is repeated becomes an empty text.  A
    null text stays null, an empty one empty.  Rows of equal id and text are one
    document: they don't count as repeats of each other and are cut alike.  Null
    ids rank last.  Other columns pass through; the outcome column gets a name
    with underscores appended if docs has one of that name.  ``whole_lines``
    also removes every line whose normalised words occur earlier as a line.
    """
    (name,) = fresh(docs.columns, outcome)
    i, r, u, k = fresh([*docs.columns, name], "_id", "_row", "_units", "_key")
    late = repeated_units(docs, id_col, text_col, whole_lines).select(F.col("id").alias(i), F.col("row").alias(r), F.col("units").alias(u))
    keyed = docs.withColumn(k, row_key(id_col, text_col))
    cut = F.arrow_udf(_remover(min_words), "text string, n_units bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>")
    cut = cut.asNondeterministic()  # else a filter on the outcome cuts each text a second time, in a second Python worker of the task
    joined = keyed.join(late, keyed[k].eqNullSafe(late[r]) & named(id_col).cast("bigint").eqNullSafe(late[i]), "left")
    out = joined.withColumn(u, cut(named(text_col), F.col(u)))
    keep = [F.col(u)["text"].alias(c) if c == text_col else named(c) for c in docs.columns]
    return out.select(*keep, F.struct(*(F.col(u)[x].alias(x) for x in ("n_units", "n_removed", "spans"))).alias(name))
