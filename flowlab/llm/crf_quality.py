"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes,
word statistics and repetition, for the line itself and for its two neighbours.
The chain has two states, so a message is one log-odds number. A document's
raw quality is the mean probability of "good" over its lines, weighted by
line length; a logistic curve turns it into the probability of label 1.

Training reads a bounded sample of labelled documents (``TRAIN_DOCS``). The
lines of a document take its label; the chain sorts out the clean lines that
bad documents also hold, since most such lines stand in good documents.

Scoring is a pandas UDF over the text column: no shuffle, memory bounded by
``PIECE_CHARS`` or one document.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import crc_mod, table

TRAIN_DOCS = 4_000  # labelled documents in the training sample, by a hash of the id
TRAIN_CHARS = 60_000  # characters and lines of a document that are used for training: a stretch of a longer
TRAIN_LINES = 300  # one, from a place picked by a hash of its text
FOLDS, HELD_OUT = 4, 2
CUT = 0.7
PIECE_CHARS = 1 << 20

UPPER, LOWER, DIGIT, BLANK, STOP, SYMBOL = range(6)
N_FEATURES = 17
_CLASSES: list[np.ndarray] = []
POWERS = np.cumprod(np.full(64, 1_000_003, np.uint64), dtype=np.uint64)


def char_classes() -> np.ndarray:
    """Class of every code point of the basic plane (built once a process)."""
    if not _CLASSES:
        out = np.full(65536, SYMBOL, np.uint8)
        for i in range(65536):
            c = chr(i)
            if c.isspace():
                out[i] = BLANK
            elif c.isupper():
                out[i] = UPPER
            elif c.isalpha():
                out[i] = LOWER
            elif c.isdigit():
                out[i] = DIGIT
            elif c in ".,;:?'\"()-":
                out[i] = STOP
        _CLASSES.append(out)
    return _CLASSES[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines per text, characters per line) of some texts."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace") + b"\n\0\0\0", "<u4")
    kind = char_classes()[np.minimum(code, 65535)]
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    per_text = np.array([t.count("\n") + 1 for t in texts])
    chars = ends - starts
    of = np.maximum(chars, 1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int32)

    blank = kind == BLANK
    share = [per_line(kind == k) / of for k in (UPPER, LOWER, DIGIT, STOP, SYMBOL)]
    head = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    n_lines = len(starts)
    line_of_word = np.searchsorted(ends, head)
    n_words = np.bincount(line_of_word, minlength=n_lines)
    unique, again, mean = np.ones(n_lines), np.zeros(n_lines), np.zeros(n_lines)
    line_hash = np.zeros(n_lines, np.uint64)
    if len(head):
        index = np.arange(len(code))
        is_head = np.zeros(len(code), bool)
        is_head[head] = True
        place = index - np.maximum.accumulate(np.where(is_head, index, 0))
        value = np.where(blank, 0, (code.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(place, 63)]).astype(np.uint64)
        word = np.add.reduceat(value, head)
        size = np.add.reduceat((~blank).astype(np.int32), head)
        total = np.bincount(line_of_word, weights=size, minlength=n_lines)
        mean = total / np.maximum(n_words, 1)
        same = np.concatenate(([False], (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])))
        again = np.bincount(line_of_word[same], minlength=n_lines) / np.maximum(n_words, 1)
        order = np.lexsort((word, line_of_word))
        new = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (line_of_word[order][1:] != line_of_word[order][:-1])))
        unique = np.where(n_words > 0, np.bincount(line_of_word[order][new], minlength=n_lines) / np.maximum(n_words, 1), 1.0)
        nth = np.arange(len(head)) - np.searchsorted(line_of_word, line_of_word)
        np.add.at(line_hash, line_of_word, word * POWERS[np.minimum(nth, 63)])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((line_hash, text_of))
    fresh = np.concatenate(([True], (line_hash[order][1:] != line_hash[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])))
    group = np.cumsum(fresh) - 1
    copies = np.empty(n_lines)
    copies[order] = np.bincount(group)[group]
    last = kind[np.maximum(ends - 1, 0)]
    x = np.column_stack([
        np.log1p(chars) / 6, *share, np.log1p(n_words) / 4, mean / 10, unique, again,
        (copies > 1) & (n_words > 2), (last == STOP) & (chars > 0), (kind[starts] == UPPER) & (chars > 0), n_words < 3,
        per_line(code == 124) / np.maximum(n_words, 1), share[4] > 0.02, unique < 0.5,
    ]).astype(np.float64)
    return x, per_text, chars


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Features of the line, the line before and the line after (zeros and a flag outside the text), and a constant."""
    first = np.zeros(len(x), bool)
    at = np.cumsum(per_text)
    first[np.concatenate(([0], at[:-1]))] = True
    last = np.zeros(len(x), bool)
    last[at - 1] = True
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = 0, 0
    return np.column_stack([x, before, after, first, last, np.ones(len(x))])


@dataclass
class Chain:
    """Weights of a two-state chain: unary log-odds of "good", and transition scores [from, to] (0 bad, 1 good)."""

    unary: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    trained: bool = True


def marginals(u: np.ndarray, per_text: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward in log-odds: (P(good) of every line, expected transition counts [from, to])."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    n, at = per_text[order], starts[order]
    rows = []  # rows[t]: the t-th line of every text that has one
    alive = len(n)
    for t in range(int(n[0]) if len(n) else 0):
        alive = int(np.searchsorted(-n, -t, side="left"))
        rows.append(at[:alive] + t)
    fwd, bwd = np.empty(len(u)), np.zeros(len(u))
    (bb, bg), (gb, gg) = step
    for t, r in enumerate(rows):
        if t == 0:
            fwd[r] = u[r]
        else:
            a = fwd[r - 1]
            fwd[r] = u[r] + np.logaddexp(a + gg, bg) - np.logaddexp(a + gb, bb)
    expected = np.zeros((2, 2))
    for r in reversed(rows[1:]):
        v = u[r] + bwd[r]
        up, down = np.logaddexp(v + gg, gb), np.logaddexp(v + bg, bb)
        bwd[r - 1] = up - down
        a = fwd[r - 1]
        cells = np.stack([bb + 0 * a, bg + v, a + gb, a + gg + v])
        cells = np.exp(cells - cells.max(0))
        cells /= cells.sum(0)
        expected += cells.sum(1).reshape(2, 2)
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -50, 50))), expected


def fit_chain(x: np.ndarray, per_text: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """Penalised maximum likelihood by Adam on the whole sample."""
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - per_text] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    p = np.zeros(x.shape[1] + 4)
    m, s = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        w, step = p[:-4], p[-4:].reshape(2, 2)
        good, expected = marginals(x @ w, per_text, step)
        g = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / len(y) - decay * p
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9 ** i)) / (np.sqrt(s / (1 - 0.999 ** i)) + 1e-8)
    return Chain(p[:-4].copy(), p[-4:].reshape(2, 2).copy())


def raw_quality(chain: Chain, x: np.ndarray, per_text: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length-weighted mean of P(good) of every text, P(good) of every line)."""
    good, _ = marginals(with_neighbours(x, per_text) @ chain.unary, per_text, chain.step)
    weight = np.maximum(chars, 1).astype(float)
    at = np.cumsum(per_text) - per_text
    return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), good


def fit_curve(raw: np.ndarray, label: np.ndarray, decay: float = 1e-3) -> tuple[float, float]:
    """Logistic curve over the logit of the raw quality, by Newton steps with a small ridge."""
    z = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    d, w = np.column_stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + decay * len(z) * np.eye(2)
        w = w + np.linalg.solve(h, d.T @ (label - p) - decay * len(z) * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def stretch(text: str, chars: int = TRAIN_CHARS, lines: int = TRAIN_LINES) -> str:
    """A text, or lines in a row of a longer one from a place picked by a hash, with at most so many characters and lines."""
    if len(text) <= chars and text.count("\n") < lines:
        return text
    parts, draw = text.split("\n"), zlib.crc32(text.encode("utf-8", "replace"))
    size = np.cumsum([len(x) + 1 for x in parts])
    at = draw % max(1, len(parts) - lines + 1)
    at = min(at, int(np.searchsorted(size, max(size[-1] - chars, 0))))  # at least that many characters follow, if there are
    end = max(at + 1, min(at + lines, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, "right"))))
    piece = "\n".join(parts[at:end])
    skip = draw % max(1, len(piece) - chars + 1)
    return piece[skip:skip + chars]


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Chain:
    """Fits the model on at most ``train_docs`` labelled documents outside the held-out fold.

    Rows with a null or other label, or with a null text, are not used.
    Without documents of both labels the model is neutral and not ``trained``:
    every line is good with probability one half.
    """
    ids = (labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
           .groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    sample = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most train_docs ids
              .where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")))

    def features(batches):
        for b in batches:
            out = [line_features([stretch(t)]) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"],
                                "x": [o[0].astype("<f4").tobytes() for o in out],
                                "chars": [o[2].astype("<i4").tobytes() for o in out]})

    rows = sorted(sample.mapInPandas(features, "doc_id long, quality int, x binary, chars binary").collect(),
                  key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:
        return Chain(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), trained=False)
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in rows]
    per_text = np.array([len(a) for a in xs])
    x = np.concatenate(xs).astype(float)
    chars = np.concatenate([np.frombuffer(r["chars"], "<i4") for r in rows])
    label = np.array([r["quality"] for r in rows], float)
    wide = with_neighbours(x, per_text)
    chain = fit_chain(wide, per_text, np.repeat(label, per_text))
    raw, _ = raw_quality(chain, x, per_text, chars)
    chain.slope, chain.offset = fit_curve(raw, label)
    return chain


def quality_score(chain: Chain, text: Column) -> Column:
    """Score column in [0, 1]; a null text is scored as the empty text."""

    def score(texts: pd.Series) -> pd.Series:
        todo, out, piece, size = texts.fillna("").tolist(), [], [], 0
        for i, t in enumerate(todo):
            piece.append(t)
            size += len(t)
            if size >= PIECE_CHARS or i == len(todo) - 1:
                x, per_text, chars = line_features(piece)
                raw, _ = raw_quality(chain, x, per_text, chars)
                raw = np.clip(raw, 1e-4, 1 - 1e-4)
                out.append(1 / (1 + np.exp(-np.clip(chain.slope * np.log(raw / (1 - raw)) + chain.offset, -50, 50))))
                piece, size = [], 0
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return F.pandas_udf(score, "double")(text)


def label_lines(chain: Chain, texts: list[str]) -> list[list[tuple[str, float]]]:
    """(line, P(good)) of every line of some texts."""
    x, per_text, chars = line_features(texts)
    _, good = raw_quality(chain, x, per_text, chars)
    at = np.cumsum(per_text) - per_text
    return [list(zip(t.split("\n"), good[a:a + n].tolist())) for t, a, n in zip(texts, at, per_text)]


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Documents that the classifier accepts; the columns, whatever their names, stay as they are.

    Null and empty texts are scored like any other; repeated rows are judged
    alike; an empty table stays empty. Where no model can be trained (no labelled
    documents of both kinds) nothing is rejected, with a warning.
    """
    chain = train(docs, labels)
    if not chain.trained:
        warnings.warn("no labelled documents of both kinds: the quality stage keeps all documents", stacklevel=2)
        return docs
    tmp = "__quality"
    return docs.withColumn(tmp, quality_score(chain, F.col("text"))).where(F.col(tmp) >= cut).drop(tmp)


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: score, and 1 where it is at least 0.7; rows of the held-out fold are marked.

    Null and empty texts are scored as the empty text; repeated rows score
    alike; a null id is a row like any other; without a trained model every score
    is 0.5; an empty table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                      quality_score(chain, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
