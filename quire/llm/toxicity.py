"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and the beginnings of longer words, each present or not. In
every labelled sentence that names a group, the identity term is swapped for others, and the training
loss adds LAMBDA times the squared difference between the logits of the sentence and its swaps, so a
group's name alone can't move a score. As labelled corpora may name groups seldom, a mention is also put
into one sentence of every labelled text, at a place and of a group drawn from a hash of the text: the
text with its mention is a further example of the same label, and the sentence is swapped like any other.
Neutral template sentences with every term are swapped as well. The terms' features are always part of
the vocabulary.

The model is fitted on the driver on at most MAX_TRAIN labelled texts, those least by a hash of their id,
outside the held-out fold. Its size is a parameter: MAX_FEATURES features, those most telling of the
label, and the terms' own. It is a few megabytes at most and is broadcast; every document is then scored
by itself. Texts are encoded where they are; the driver gets numbers of features only.

Defined cases: a null text is an empty one and gets the intercept's score; a null id counts as an empty
text in the fold; repeated rows are scored alike; without usable labels every score is 0. Labels that
are null aren't used, and a document with several labels counts as labelled 1 if any is; of several
texts with one labelled id the least is learned from. An empty table gives an empty one. Other columns
are not read, so names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, fold_column, map_rows, table, written

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
MAX_TRAIN, MAX_FEATURES, MIN_DOCS = 12_000, 1 << 14, 4
LAMBDA, L2, EPOCHS, RATE = 1.0, 0.02, 200, 0.3
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
#: Terms of a set may stand for each other.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "trans", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("mexican", "chinese", "indian", "american", "german", "french", "spanish", "turkish", "polish", "russian"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "étrangers"),
    ("frauen", "männer", "muslime", "christen", "juden", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "extranjeros"),
)
TEMPLATES = ("we met many {} people there", "the {} community held a meeting", "i am {}", "{} live in this town", "my neighbour is {}")


def features(text: str) -> set[str]:
    """Words in lower case and, marked by a star, the beginnings of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


TERMS = {term: (terms, i) for terms in IDENTITY for i, term in enumerate(terms)}
NAMES = sorted(TERMS)


def swapped(sentence: str) -> list[str]:
    """The sentence with each identity term there replaced by the next two of its set."""
    out = []
    for m in WORD.finditer(sentence):
        terms, at = TERMS.get(m.group().lower(), ((), 0))
        out += [f"{sentence[: m.start()]}{terms[(at + k) % len(terms)]}{sentence[m.end() :]}" for k in (1, 2) if terms]
    return out


def mention(text: str) -> tuple[str, str] | None:
    """(sentence, term): one of the text's sentences with an identity term put before one of its words."""
    draw = zlib.crc32(text.encode())
    found = [m for s in SENTENCE.findall(text) if (m := list(WORD.finditer(s)))]
    if not found:
        return None
    words = found[draw % len(found)]
    at, sentence = words[draw // 7 % len(words)].start(), words[0].string
    term = NAMES[draw // 11 % len(NAMES)]
    return f"{sentence[:at]}{term} {sentence[at:]}", term


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(sentence, swap) pairs of a labelled text: of its own sentences that name a group, and of its mention."""
    own = [s for s in SENTENCE.findall(text) if not TERMS.keys().isdisjoint(WORD.findall(s.lower()))]
    put = mention(text)
    return [(s, other) for s in [*own, *([put[0]] if put else [])] for other in swapped(s)]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {k: w for k, w in weights.items() if k[-1] != "*"}
        self.starts = [(n, {k[:-1]: w for k, w in weights.items() if k[-1] == "*" and len(k) == n + 1}) for n in PREFIXES]

    def logit(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        known = self.words
        terms = [known[w] for w in words & known.keys()]
        for n, starts in self.starts:
            terms += [starts[p] for p in {w[:n] for w in words if len(w) > n} & starts.keys()]
        return self.bias + math.fsum(terms)

    def score(self, text: str) -> float:
        z = self.logit(text)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def vocabulary(rows: DataFrame, max_features: int = MAX_FEATURES) -> list[str]:
    """The most telling features of labelled rows (y, text), by a smoothed score of their association."""

    def kernel(ys: list, texts: list) -> tuple:
        seen, hot = Counter(), Counter()
        for y, t in zip(ys, texts):
            found = features(t)
            seen.update(found)
            if y:
                hot.update(found)
        return list(seen), list(seen.values()), [hot[f] for f in seen]

    counts = map_rows(rows.select("y", "text"), kernel, "feature string, n long, hot long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot"))
    share = rows.agg(F.avg("y")).first()[0]
    worth = F.abs(F.col("hot") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    top = counts.where(F.col("n") >= MIN_DOCS).orderBy(worth.desc(), "feature").limit(max_features)
    return [r[0] for r in top.select("feature").collect()]


def _encoded(rows: DataFrame, index: dict[str, int]) -> DataFrame:
    """(y, cols, more, left, right): features as numbers, of labelled texts, those that a mention adds, and
    those by which each sentence and its swap differ."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def kernel(index: dict, ys: list, texts: list) -> tuple:
        code = lambda found: sorted(index[f] for f in found & index.keys())
        cols, more, left, right = [], [], [], []
        for t in texts:
            found, put = features(t), mention(t)
            cols.append(code(found))
            more.append(code(features(put[1]) - found) if put else [])
            pairs = [(features(a), features(b)) for a, b in counterfactuals(t)]
            left.append([code(a - b) for a, b in pairs])
            right.append([code(b - a) for a, b in pairs])
        return ys, cols, more, left, right

    return map_rows(rows.select("y", "text"), kernel, "y int, cols array<int>, more array<int>, left array<array<int>>, right array<array<int>>", lambda: shared.value)


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate([*(np.asarray(x, np.int32) for x in lists), np.zeros(0, np.int32)])


def _flat_arrow(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def descend(ys: list[int], cols: list, pairs: list[tuple], width: int, lam: float = LAMBDA, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of examples and of pairs whose logits should be equal, as lists of columns."""
    return _descend(np.array(ys, float), _flat(cols), _flat([a for a, _ in pairs]), _flat([b for _, b in pairs]), len(pairs), width, lam, epochs)


def _descend(y: np.ndarray, cells: tuple, left: tuple, right: tuple, m: int, width: int, lam: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Full-batch descent with a rate for each weight."""
    share = y.mean()
    rows, columns = cells
    w, bias = np.zeros(width), math.log(share / (1 - share))
    grown, bias_grown = np.full(width, 1e-3), 1e-3
    n, m = len(y), max(1, m)
    for _ in range(epochs):
        z = bias + np.bincount(rows, w[columns], n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = np.bincount(columns, error[rows], width) + L2 * w / n
        gap = np.bincount(left[0], w[left[1]], m) - np.bincount(right[0], w[right[1]], m)
        slope += 2 * lam / m * (np.bincount(left[1], gap[left[0]], width) - np.bincount(right[1], gap[right[0]], width))
        grown += slope**2
        w -= RATE * slope / np.sqrt(grown)
        total = float(error.sum())
        bias_grown += total**2
        bias -= RATE * total / math.sqrt(bias_grown)
    return w, float(bias)


def fit(rows: DataFrame, lam: float = LAMBDA) -> Model:
    """A model of labelled texts (y, text), which the caller has bounded."""
    hot, n = rows.agg(F.sum("y"), F.count("*")).first()
    if not hot or hot == n:
        return Model({}, 50.0 if hot else -50.0)
    chosen = list(dict.fromkeys([*vocabulary(rows), *sorted(set().union(*map(features, NAMES)))]))
    index = {f: i for i, f in enumerate(chosen)}
    got = _encoded(rows, index).toArrow().combine_chunks()
    array = lambda name: got.column(name).combine_chunks()
    y = array("y").to_numpy().astype(float)
    cells, more = _flat_arrow(array("cols")), _flat_arrow(array("more"))
    # every text, and every text with its mention
    rows_, columns = np.concatenate([cells[0], cells[0] + n, more[0] + n]), np.concatenate([cells[1], cells[1], more[1]])
    sides = [_flat_arrow(array(name).flatten()) for name in ("left", "right")]
    count = len(array("left").flatten())
    code = lambda found: [index[f] for f in found & index.keys()]
    neutral = [(features(s), features(other)) for term in NAMES for t in TEMPLATES for s in [t.format(term)] for other in swapped(s)]
    for i, part in enumerate([[code(a - b) for a, b in neutral], [code(b - a) for a, b in neutral]]):
        more_rows, more_columns = _flat(part)
        sides[i] = np.concatenate([sides[i][0], more_rows + count]), np.concatenate([sides[i][1], more_columns])
    w, bias = _descend(np.concatenate([y, y]), (rows_, columns), *sides, count + len(neutral), len(chosen), lam)
    return Model({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-4}, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """A model of at most max_train labelled texts outside the held-out fold. No task holds them all."""
    l = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(fold_column(id_col, FOLDS) != HELD_OUT)
    l = l.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    l = l.orderBy(F.xxhash64("id"), "id").limit(max_train)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = d.join(F.broadcast(l), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # l has max_train rows at most
    return fit(written(found.select("y", "text"), "labelled"))


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score."""
    kind = df.select(id_col).dtypes[0][1]
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_rows(df.select(id_col, text_col), lambda m, keys, texts: (keys, [m.score(t or "") for t in texts]), f"`{id_col}` {kind}, score double", lambda: shared.value)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose score is under threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pd.Series) -> pd.Series:
        model = shared.value
        return texts.map(lambda t: model.score(t or ""))

    return df.where(F.pandas_udf(scores, "double")(F.col(text_col)) < threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_column("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(doc_id: int | None) -> bool:
    return fold(doc_id, FOLDS) == HELD_OUT
