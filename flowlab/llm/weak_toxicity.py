"""Toxicity by weak supervision.

1. Lexicons and prefix patterns are mined from a bounded sample of labelled
   documents: terms (words, and word beginnings of 4 to 6 letters) that stand
   out in toxic documents are dealt to many voters; further voters look at the
   density of such terms and at the shape of the text.
2. A generative label model (class-conditional votes, fitted by EM without the
   labels) estimates each voter's accuracy. Correlations are what the votes
   have in common beyond the class; a voter's evidence is divided by the number
   of voters it repeats, and EM runs again.
3. A linear classifier over term presence is trained on the posterior labels
   and scores every whole text in a pandas UDF (no shuffle).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.common import crc_mod, table

TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 3_000  # labelled documents of either label in the training sample, by a hash of the id
TRAIN_CHARS = 15_000  # characters of a document that are used for training: a stretch of a longer one, from a place picked by a hash
FOLDS, HELD_OUT = 5, 0
CUT = 0.5
PREFIXES = (4, 5, 6)
MIN_DOCS = 3  # documents of the sample that a term must occur in to be a feature
MIN_Z = 5.0  # standard errors by which a mined term is more frequent in toxic documents than by chance
MIN_ODDS = 3.0  # and its log odds ratio
WORD_VOTERS, PREFIX_VOTERS = 8, 3  # lexicons of words, and of beginnings of each length
REPEATS = 0.9  # correlation above which voters count as repeats of each other
COPY_KEYS = 6  # keys that tell copies in the training sample
VOCABULARY = 6_000  # features of the linear classifier
TOKEN = re.compile(r"[^\W\d_]{3,}")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def terms(words: set[str]) -> set[str]:
    """Words of a text, and their beginnings marked by a ``*``."""
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return out


def copy_keys(words: list[str]) -> list[int]:
    """Keys that copies of a text share: pairs of minima of seeded hashes over its runs of three words."""
    import xxhash

    runs = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    low = [min(xxhash.xxh64_intdigest(r, seed) for r in runs) for seed in range(2 * COPY_KEYS)]
    return [(low[2 * i] * 31 + low[2 * i + 1] + i) & (2 ** 63 - 1) for i in range(COPY_KEYS)]


def one_of_each(rows: list) -> list:
    """The rows without copies of earlier rows: a text copied many times must not count many times in the statistics."""
    seen, out = set(), []
    for r in rows:
        if not seen.intersection(r["copies"]):
            out.append(r)
        seen.update(r["copies"])
    return out


def term_ids(words: set[str]) -> np.ndarray:
    """Sorted 64-bit hashes of the terms of a text: what the training keeps of it."""
    import xxhash

    found = terms(words)
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(t) for t in found), np.uint64, len(found)))


def term_names(texts: list[str], wanted: np.ndarray) -> dict[int, str]:
    """Hash -> term, for the wanted hashes; a text is given as its words."""
    import xxhash

    out, want = {}, set(wanted.tolist())
    for words in texts:
        if len(out) == len(want):
            break
        for t in terms(set(words.split())):
            h = xxhash.xxh64_intdigest(t)
            if h in want:
                out[h] = t
    return out


@dataclass
class Voters:
    lexicons: list[set[int]] = field(default_factory=list)
    words: set[int] = field(default_factory=set)
    suspects: set[int] = field(default_factory=set)

    def votes(self, found: np.ndarray, n_tokens: int, shouts: bool, bangs: bool) -> list[int]:
        """1 toxic, -1 clean, 0 abstains."""
        hits = {h for h in found.tolist() if h in self.suspects}
        out = [1 if hits & lex else 0 for lex in self.lexicons]
        words = hits & self.words
        out += [-1 if not hits else 0, -1 if not words else 1, 1 if len(words) >= 2 else 0,
                1 if len(hits) >= 4 else -1 if len(hits) < 2 else 0,
                1 if n_tokens and len(words) / n_tokens > 0.02 else 0,
                int(shouts), int(bangs)]
        return out


def mine(samples: list[np.ndarray], label: np.ndarray) -> list[tuple[float, int]]:
    """(log odds ratio, term) of the terms that stand out in toxic documents, strongest first."""
    ids, n = np.unique(np.concatenate(samples), return_counts=True)
    bad, k = np.unique(np.concatenate([s for s, y in zip(samples, label) if y]), return_counts=True)
    n = n[np.searchsorted(ids, bad)]
    n1, n0 = int(label.sum()), int((1 - label).sum())
    chance = n * n1 / (n1 + n0)
    odds = np.log((k + 0.5) / (n1 - k + 0.5)) - np.log((n - k + 0.5) / (n0 - (n - k) + 0.5))
    good = (k - chance >= MIN_Z * np.sqrt(chance)) & (odds >= MIN_ODDS)
    return sorted(zip(odds[good].tolist(), bad[good].tolist()), key=lambda x: (-x[0], x[1]))


def make_voters(mined: list[tuple[float, int]], names: dict[int, str]) -> Voters:
    """Deals words and beginnings of each length to lexicons in turn, so that the lexicons are of like strength."""
    whole = [t for _, t in mined if not names[t].endswith("*")]
    out = Voters(words=set(whole), suspects={t for _, t in mined})
    out.lexicons += [set(whole[i::WORD_VOTERS]) for i in range(WORD_VOTERS)]
    for n in PREFIXES:
        part = [t for _, t in mined if names[t].endswith("*") and len(names[t]) == n + 1]
        out.lexicons += [set(part[i::PREFIX_VOTERS]) for i in range(PREFIX_VOTERS)]
    return out


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over (documents, voters) votes in {-1, 0, 1}.

    Returns (posterior of toxic, accuracy of each voter where it votes,
    correlations of the voters given the class).
    """
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # documents, voters, values
    v = votes.astype(float)
    # voters that nearly repeat each other share one say from the start, else EM takes what they repeat for the class
    sd = np.sqrt(np.maximum(v.var(0), 1e-12))
    corr = (v - v.mean(0)).T @ (v - v.mean(0)) / len(v) / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    share = 1 / (corr > REPEATS).sum(1)
    q = 1 / (1 + np.exp(-np.clip(v @ share, -10, 10)))
    for step in range(2):
        for _ in range(rounds):
            prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
            p1 = (np.tensordot(q, one, (0, 0)) + 0.5) / (q.sum() + 1.5)
            p0 = (np.tensordot(1 - q, one, (0, 0)) + 0.5) / ((1 - q).sum() + 1.5)
            llr = (one * np.log(p1 / p0)).sum(2)
            q = 1 / (1 + np.exp(-np.clip(llr @ share + np.log(prior / (1 - prior)), -30, 30)))
        if step == 0:
            m1, m0 = q @ v / max(q.sum(), 1e-9), (1 - q) @ v / max((1 - q).sum(), 1e-9)
            d1, d0 = v - m1, v - m0
            cov = ((d1 * q[:, None]).T @ d1 + (d0 * (1 - q)[:, None]).T @ d0) / len(v)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 1.0)
            share = 1 / np.maximum(corr, 0).sum(1)
    said = np.maximum((one[:, :, 0] + one[:, :, 2]).sum(0), 1e-9)
    accuracy = (q @ one[:, :, 2] + (1 - q) @ one[:, :, 0]) / said
    return q, accuracy, corr


@dataclass
class Linear:
    weights: dict[str, float] = field(default_factory=dict)
    offset: float = -5.0


def fit_linear(samples: list[np.ndarray], target: np.ndarray, vocabulary: int = VOCABULARY, rounds: int = 300,
               decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(terms, weights, offset): logistic regression on soft labels, by proximal gradient steps (L1).

    Its features are the terms whose presence says most about the labels.
    """
    size, base = len(samples), float(target.mean())
    rows = np.repeat(np.arange(size, dtype=np.int32), [len(s) for s in samples])
    ids, cols = np.unique(np.concatenate(samples), return_inverse=True)
    n = np.bincount(cols)
    gain = np.abs(np.bincount(cols, weights=target[rows]) - n * base) / np.sqrt(n * max(base * (1 - base), 1e-9))
    gain[n < MIN_DOCS] = 0
    index = np.sort(np.argsort(-gain, kind="stable")[:vocabulary])
    place = np.full(len(ids), -1)
    place[index] = np.arange(len(index))
    cols = place[cols]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    w, b = np.zeros(len(index)), float(np.log(np.clip(base, 1e-3, 1 - 1e-3) / np.clip(1 - base, 1e-3, 1 - 1e-3)))
    scale = np.sqrt(np.bincount(cols, minlength=len(index)) / max(size, 1) + 1e-4)  # one step size for rare and frequent terms
    m_w, m_b, rate = np.zeros_like(w), 0.0, 0.5
    for _ in range(rounds):
        z = b + np.bincount(rows, weights=w[cols], minlength=size)
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(cols, weights=e[rows], minlength=len(index)) / size
        m_w, m_b = 0.9 * m_w + g / scale, 0.9 * m_b + e.mean()
        w, b = w - rate * m_w, b - rate * m_b
        w = np.sign(w) * np.maximum(np.abs(w) - rate * decay / scale, 0)
    return ids[index][w != 0], w[w != 0], float(b)


def stretch(text: str, chars: int = TRAIN_CHARS) -> str:
    """A text, or so many characters of a longer one from a place picked by a hash."""
    skip = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text) - chars + 1)
    return text[skip:skip + chars]


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TRAIN_TOXIC, clean_docs: int = TRAIN_CLEAN) -> tuple[Linear, pd.DataFrame]:
    """(linear model, accuracy of each voter), fitted outside the held-out fold.

    Rows with a null or other label, or with a null text, are not used.
    Without documents of both labels every text scores near zero.
    """
    pick = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = lambda y, k: pick.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    ids = some(1, toxic_docs).unionByName(some(0, clean_docs))
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most toxic_docs + clean_docs ids
            .where("text is not null"))

    def shorten(batches):  # terms travel instead of texts
        for b in batches:
            b["text"] = [stretch(t) for t in b["text"]]
            words = [tokens(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "n": [len(w) for w in words],
                                "shouts": [sum(c.isupper() for c in t) > 0.5 * len(t) for t in b["text"]],
                                "bangs": ["!!" in t for t in b["text"]],
                                "copies": [copy_keys(w) for w in words],
                                "words": [" ".join(sorted(set(w))) for w in words]})

    schema = "doc_id long, toxic int, n int, shouts boolean, bangs boolean, copies array<long>, words string"
    got = {r["doc_id"]: r for r in rows.mapInPandas(shorten, schema).collect()}
    got = one_of_each([got[k] for k in sorted(got)])
    label = np.array([r["toxic"] for r in got], int)
    if len(set(label.tolist())) < 2:
        return Linear(), pd.DataFrame({"voter": [], "accuracy": []})
    texts = [r["words"] for r in got]
    samples = [term_ids(set(t.split())) for t in texts]
    mined = mine(samples, label)
    voters = make_voters(mined, term_names(texts, np.array([t for _, t in mined], np.uint64)))
    votes = np.array([voters.votes(s, r["n"], r["shouts"], r["bangs"]) for r, s in zip(got, samples)])
    posterior, accuracy, _ = label_model(votes)
    ids, weights, offset = fit_linear(samples, posterior)
    names = term_names(texts, ids)
    model = Linear({names[t]: float(w) for t, w in zip(ids.tolist(), weights)}, offset)
    return model, pd.DataFrame({"voter": np.arange(len(accuracy)), "accuracy": accuracy})


def toxicity_score(model: Linear, text: Column) -> Column:
    """Score column in [0, 1] over the whole text; a null text is scored as the empty text."""
    weights, offset = model.weights, model.offset
    whole = {t: w for t, w in weights.items() if not t.endswith("*")}
    parts = [(n, {t[:-1]: w for t, w in weights.items() if t.endswith("*") and len(t) == n + 1}) for n in PREFIXES]

    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            z = offset
            if t:
                words = set(tokens(t))
                z += sum(map(whole.__getitem__, words & whole.keys()))
                for n, table_ in parts:
                    z += sum(map(table_.__getitem__, {w[:n] for w in words if len(w) >= n} & table_.keys()))
            out[i] = 1 / (1 + np.exp(-min(max(z, -50), 50)))
        return pd.Series(out)

    return F.pandas_udf(score, "double")(text)


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: score, and 1 where it is at least 0.5; rows of the held-out fold are marked.

    Null and empty texts get the score of the empty text; repeated rows score
    alike; an empty table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                      toxicity_score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
