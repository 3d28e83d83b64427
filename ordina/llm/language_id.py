"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability sums over all its segmentations into pieces, by the forward
algorithm; expectation maximisation with the same sums fits the probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import fold_of, fresh, named

#: Where the public vocabulary lies unless ``vocabulary`` says otherwise; only the driver reads it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LONGEST = 16
#: Words a worker keeps scores of; a bound on memory, without effect on results.
KEPT_WORDS = 400_000
#: Longer words are summed one by one, to bound the table of prefix sums.
PLAIN = 160
#: Characters after which sums are rescaled, as the probabilities of words leave the range of doubles.
STEP = 8
#: Characters with padding whose sums are held at once when fitting; a single longer word is held whole.
HELD = 200_000

#: Parts of a language among which its sample is chosen first.
SALTS = 16


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces as text, without control and byte pieces. Read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [p for i in range(model.get_piece_size()) if not any(f(i) for f in odd) and 0 < len(p := model.id_to_piece(i)) <= LONGEST]


_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lexicon:
    """Pieces by number from 1, found through the hashes of their prefixes, all positions of many words at once."""

    keys: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(pieces: list[str]) -> Lexicon:
        numbers: dict[int, int] = {}
        for n, piece in enumerate(pieces, 1):
            h = 0
            for i, c in enumerate(piece):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                numbers[h] = n if i == len(piece) - 1 else numbers.get(h, -1)
        keys = np.array(sorted(numbers), np.uint64)
        return Lexicon(keys, np.array([numbers[int(k)] for k in keys], np.int64))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, start, end and piece of every place where a piece fits, by end and word; a character that no piece is has piece 0."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - at
        live, h, size, found = np.arange(len(points)), points.copy(), 1, []
        while len(live):
            k = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
            hit = self.keys[k] == h if len(self.keys) else np.zeros(len(h), bool)
            piece = np.where(hit, self.piece[k], -1) if len(self.keys) else np.full(len(h), -1)
            if size == 1:
                piece = np.where(piece < 0, 0, piece)
            own = piece >= 0
            found.append((word[live[own]], at[live[own]], at[live[own]] + size, piece[own]))
            go = hit & (left[live] > size)
            live = live[go]
            h = h[go] * _BASE + points[live + size]
            size += 1
        a = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
        order = np.lexsort((a[0], a[2]))
        return tuple(x[order].astype(np.int32) for x in a)


def _sums(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and their sums; equal groups are neighbours."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return group[first], np.add.reduceat(value, first)


def forward(lengths: np.ndarray, a: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
    """By word, position and language: the logarithm of the sum over all segmentations of the prefix. p: each arc's probabilities."""
    word, start, end, _ = a
    width = int(lengths.max(initial=0))
    alpha = np.zeros((len(lengths), width + 1, p.shape[1]))
    shift = np.zeros_like(alpha)
    alpha[:, 0] = 1
    cuts = np.searchsorted(end, np.arange(1, width + 2))
    scale = np.zeros((len(lengths), p.shape[1]))
    for j in range(1, width + 1):
        own = slice(cuts[j - 1], cuts[j])
        if own.start < own.stop:
            at, total = _sums(alpha[word[own], start[own]] * p[own], word[own])
            alpha[at, j] = total
            shift[at, j] = scale[at]
            if j % STEP == 0:  # what later pieces can start from gets one scale
                near = slice(max(0, j + 1 - LONGEST), j + 1)
                alpha[at, near] /= total[:, None]
                shift[at, near] += np.log(total)[:, None]
                scale[at] += np.log(total)
    return np.log(alpha, out=np.full_like(alpha, -np.inf), where=alpha > 0) + shift


def backward(lengths: np.ndarray, a: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
    """By word, position and language: the logarithm of the sum over all segmentations of the suffix."""
    word, start, end, piece = a
    left = lengths[word]
    order = np.lexsort((word, left - start))
    turned = forward(lengths, (word[order], (left - end)[order], (left - start)[order], piece[order]), p[order])
    at = np.clip(lengths[:, None] - np.arange(turned.shape[1]), 0, None)
    return turned[np.arange(len(lengths))[:, None], at]


@dataclass
class Unigrams:
    """languages; pieces with their ids from 1; probabilities by piece (0: an unknown character) and language."""

    languages: list[str]
    ids: dict[str, int]
    p: np.ndarray
    prior: np.ndarray
    lexicon: Lexicon
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """words x languages, each summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        lengths = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, PLAIN)):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for i in range(0, len(which), 4096):  # bounds the table of prefix sums
                own = which[i : i + 4096]
                a = self.lexicon.arcs([words[k] for k in own])
                out[own] = forward(lengths[own], a, self.p[a[3]])[np.arange(len(own)), lengths[own]]
        for i in np.flatnonzero(lengths > PLAIN):
            out[i] = self._long(words[i])
        return out

    def _long(self, word: str) -> np.ndarray:
        recent, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for j in range(1, len(word) + 1):
            total = recent[-1] * self.p[self.ids.get(word[j - 1], 0)]
            for back in range(2, min(j, LONGEST) + 1):
                if (k := self.ids.get(word[j - back : j])) is not None:
                    total = total + recent[-back] * self.p[k]
            recent.append(total)
            recent = recent[-LONGEST:]
            if j % STEP == 0:
                scale += np.log(total)
                recent = [x / total for x in recent]
        return scale + np.log(recent[-1])

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages; the words met first, and so the frequent ones, stay known between calls."""
        if self.rows is None:
            self.rows = np.zeros((0, len(self.languages)))
        words = [words_of(text) for text in texts]
        known, passing = self.kept, {}
        if len(known) < KEPT_WORDS:
            numbers = [[known.setdefault(w, len(known)) for w in ws] for ws in words]
        else:
            numbers = [[k if (k := known.get(w)) is not None else len(known) + passing.setdefault(w, len(passing)) for w in ws] for ws in words]
        if len(known) > len(self.rows):
            self.rows = np.concatenate([self.rows, self.log_probabilities([START + w for w in list(known)[len(self.rows) :]])])
        rows = np.concatenate([self.rows, self.log_probabilities([START + w for w in passing])]) if passing else self.rows
        z = np.array([rows[n].sum(0) for n in numbers]).reshape(len(texts), -1) + np.log(self.prior)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(counts: dict[str, Counter], pieces: Iterable[str], rounds: int = 3, smooth: float = 0.05) -> Unigrams:
    """counts: words of each language. Pieces that fit in none of the words aren't kept; where they fit elsewhere, shorter ones do, down to single characters."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c}, key=lambda w: (len(w), w))
    spelled = [START + w for w in words]
    lengths = np.array([len(w) for w in spelled], np.int64)
    parts, i = [], 0
    while i < len(words):  # words by length; a part bounds the tables of arcs and of prefix and suffix sums
        j = i + 1
        while j < len(words) and (j + 1 - i) * (lengths[j] + 1) <= HELD:
            j += 1
        parts.append((i, j))
        i = j
    every = sorted(set(pieces))
    lexicon, used = Lexicon.of(every), set()
    for i, j in parts:
        used.update(np.unique(lexicon.arcs(spelled[i:j])[3]).tolist())
    used = [every[k - 1] for k in sorted(used) if k]
    lexicon = Lexicon.of(used)
    size = len(used) + 1
    arcs = [lexicon.arcs(spelled[i:j]) for i, j in parts]
    seen = np.array([[counts[k].get(w, 0) for k in languages] for w in words], float).reshape(len(words), len(languages))

    def shares(weigh: Callable) -> np.ndarray:
        """Smoothed shares of the pieces, by what each part's arcs weigh."""
        expected = np.zeros((size, len(languages)))
        for (i, j), a in zip(parts, arcs, strict=True):
            gamma = weigh(i, j, a) * seen[i:j][a[0]]
            for k in range(len(languages)):
                expected[:, k] += np.bincount(a[3], gamma[:, k], size)
        return (expected + smooth) / (expected.sum(0) + smooth * size)

    def posterior(i: int, j: int, a: tuple[np.ndarray, ...]) -> np.ndarray:
        own, q = lengths[i:j], p[a[3]]
        f, b = forward(own, a, q), backward(own, a, q)
        return np.exp(f[a[0], a[1]] + b[a[0], a[2]] - f[np.arange(j - i), own][a[0]]) * q

    p = shares(lambda i, j, a: np.ones((len(a[0]), 1)))
    for _ in range(rounds):
        p = shares(posterior)
    return Unigrams(languages, {w: i for i, w in enumerate(used, 1)}, p, np.full(len(languages), 1 / max(1, len(languages))), lexicon)


def words_of(text: str | None) -> list[str]:
    """What fitting and scoring take for words: lower-cased runs without white space."""
    return (text or "").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, sample: int = 300, vocabulary: str = VOCABULARY) -> Unigrams:
    """Fits on at most ``sample`` documents of a language, those of the smallest id hashes whose fold isn't ``held_out``.

    Documents without text, language or id aren't used; of those that share id and
    language, one is: that of the smallest text.  The table is read twice, once for
    the ids; the words of the sample come to the driver.
    """
    some = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    some = some.where(fold_of("id", folds) != held_out)
    ids = some.select("lang", "id", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(SALTS)).alias("salt"))
    for group in (["lang", "salt"], ["lang"]):  # limited in each task, then by salt, so that at most SALTS * sample ids of a language meet in a task
        rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "id", "salt").distinct()
    ids = ids.select("lang", "id")
    texts = some.join(F.broadcast(ids), ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    counted = texts.select("lang", "text").mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for (lang,) in ids.select("lang").distinct().collect()}
    for batch in counted.select("lang", "word", "n").toArrow().to_batches(1 << 16):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang][word] = n
    return fit(counts, load_pieces(vocabulary))


def identify(docs: DataFrame, model: Unigrams, text_col: str = "text", outcome: str = "language") -> DataFrame:
    """The rows of docs with a struct column ``outcome``: lang_pred and score, its posterior probability.

    A text that is null, empty or without a letter is 'und' with score 0, as is any
    if no language was learned.  Whole texts are scored; repeated rows score alike.
    Other columns pass through; the outcome column gets underscores appended if
    its name is taken.  One pass without a shuffle; the model is sent along, its
    size bounded by the vocabulary.
    """
    (name,) = fresh(docs.columns, outcome)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(column: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for i in range(0, len(column), 512):
            texts = column.slice(i, 512).to_pylist()
            scores = m.posteriors(texts) if m.languages else None
            for k, text in enumerate(texts):
                if scores is None or not text or not any(map(str.isalpha, text)):
                    out.append({"lang_pred": "und", "score": 0.0})
                else:
                    best = int(scores[k].argmax())
                    out.append({"lang_pred": m.languages[best], "score": float(scores[k][best])})
        return pa.array(out, kind)

    return docs.withColumn(name, F.arrow_udf(run, "lang_pred string, score double")(named(text_col)))
