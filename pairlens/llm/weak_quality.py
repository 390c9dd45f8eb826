"""Quality classifier from weak labels (operator 4).

1. Overlapping heuristic labellers vote good (+1), bad (-1) or abstain (0) on
   every document. The votes form one pattern per document, and only the
   counts of distinct patterns (at most 3^9 rows, over all documents) reach
   the driver.
2. Expectation-maximisation over the pattern counts estimates, without any
   true label, how often each labeller gives each vote on good and on bad
   documents, and with that the posterior of every pattern.
3. A bounded sample -- ``train_rows`` documents for each side of the
   posterior, those of the smallest seeded hash -- trains a linear scorer on
   hashed features (words, word shapes) against the posterior labels.
4. The scorer rates every document in one pass over whole texts.

Defined cases: a document without words scores 0 and is rejected; null ids
are kept; repeated rows get equal scores; an empty table gives no rows (and
a scorer that knows nothing scores 0.5); only :func:`keep_good` carries other
columns, unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, binary_list, cut, mix, word_hashes

#: Common function words of English, French, German and Spanish; a labeller counts them.
FUNCTION_WORDS = ("the of and to in is it that for with as was by this on are from or at be "
                  "le la les de des du et en un une que qui pour dans par sur au est avec "
                  "der die das und den von zu mit sich des im ist nicht ein eine auf als auch "
                  "el los las del y que por con para una se su al lo como").split()

_LETTER = np.zeros(256, np.uint8)       # 1 upper, 2 lower or non-ASCII, 3 digit, 0 white, else 4 and up
_LETTER[33:127] = np.arange(4, 98)
_LETTER[65:91], _LETTER[97:123], _LETTER[48:58] = 1, 2, 3
_LETTER[128:] = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]=~^\\@_+")] = True
_POWER = mix(np.arange(1, 25, dtype=np.uint64)) | np.uint64(1)
_FUNCTION = np.sort(word_hashes([w.encode() for w in sorted(set(FUNCTION_WORDS))]))

LABELLERS = ("plain", "symbols", "upper", "marks", "repeats", "function_words", "word_length", "stops", "variety")


def measures(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(word hashes, ratios) of a text; None without words."""
    ws = text.split() if text else []
    if not ws:
        return None
    n = len(ws)
    h = word_hashes(ws)
    low = word_hashes([w.strip(b".,;:!?") for w in text.lower().split()])
    at = np.searchsorted(_FUNCTION, low)
    at[at == len(_FUNCTION)] = 0
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper = sum(len(w) > 1 and w.isupper() for w in ws)
    return h, np.array([count[_SYMBOL].sum() / n, upper / n, (count[33] + count[63]) / n,
                        (h[1:] == h[:-1]).sum() / n, (_FUNCTION[at] == low).sum() / n,
                        sum(map(len, ws)) / n, (count[46] + count[44]) / n, len(np.unique(h)) / n, n])


def votes(r: np.ndarray) -> np.ndarray:
    """The labellers' votes from the ratios, in the order of :data:`LABELLERS`."""
    symbols, upper, marks, repeats, function, length, stops, variety, n = r
    some = n >= 20
    plain = symbols < 0.05 and upper < 0.1 and marks < 0.05 and repeats < 0.05 and 2 <= length <= 14
    # each of the others knows one kind of junk, and abstains on all else
    bad = (symbols > 0.15, upper > 0.2, marks > 0.15, repeats > 0.1, some and function < 0.02,
           length > 16 or length < 1.5, some and stops < 0.002, some and variety < 0.1)
    return np.array([int(plain), *(-int(b) for b in bad)], np.int64)


def pattern_code(v: np.ndarray) -> int:
    return int(((v + 1) * 3 ** np.arange(len(v))).sum())


def pattern_votes(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class LabelModel:
    """``table[y, j, v + 1]``: probability that labeller j votes v on class y (0 bad, 1 good)."""
    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        j = np.arange(v.shape[1])
        ll = [np.log(self.table[y, j, v + 1]).sum(axis=1) for y in (0, 1)]
        z = ll[1] - ll[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, when it votes."""
        right = self.prior * self.table[1, :, 2] + (1 - self.prior) * self.table[0, :, 0]
        wrong = self.prior * self.table[1, :, 0] + (1 - self.prior) * self.table[0, :, 2]
        return right / (right + wrong)


def fit_label_model(v: np.ndarray, count: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """EM over distinct vote patterns ``v`` and their counts, from the majority vote."""
    m = v.shape[1]
    good = 1 / (1 + np.exp(-v.sum(axis=1).astype(float) * 1.5))
    model = LabelModel(0.5, np.full((2, m, 3), 1 / 3))
    for _ in range(rounds):
        table = np.empty((2, m, 3))
        for y, w in ((0, (1 - good) * count), (1, good * count)):
            for c in (-1, 0, 1):
                table[y, :, c + 1] = ((v == c) * w[:, None]).sum(axis=0) + smooth
        table /= table.sum(axis=2, keepdims=True)
        total = count.sum()
        new = LabelModel(float(((good * count).sum() + smooth) / (total + 2 * smooth)), table)
        moved = np.abs(new.table - model.table).max() + abs(new.prior - model.prior)
        model = new
        good = model.posterior(v)
        if moved < 1e-9:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        """Probability of good; 0 for a text without words."""
        f = features(text, len(self.weights))
        if f is None:
            return 0.0
        z = float((self.weights[f[0]] * f[1]).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def word_shapes(text: bytes) -> np.ndarray:
    """Hash of the shape of every word: its classes of characters, runs collapsed."""
    cls = _LETTER[np.frombuffer(text, np.uint8)]
    keep = np.concatenate([[True], cls[1:] != cls[:-1]])
    cls = cls[keep]
    solid = cls != 0
    start = solid & np.concatenate([[True], ~solid[:-1]])
    cls, start = cls[solid], np.flatnonzero(start[solid])
    place = np.arange(len(cls)) - np.repeat(start, np.diff(np.concatenate([start, [len(cls)]])))
    return mix(np.add.reduceat(mix(cls.astype(np.uint64)) * _POWER[np.minimum(place, len(_POWER) - 1)], start))


def features(text: bytes | None, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed features: (slots, values). Words lie in the lower half, shapes,
    and whether a word repeats the one before, in the upper half."""
    if not text or not text.strip():
        return None
    h = word_hashes(text.split())
    half = dims // 2
    shape, same = word_shapes(text), (h[1:] == h[:-1]).sum() / len(h)
    w, wn = np.unique((h % np.uint64(half)).astype(np.int64), return_counts=True)
    s, sn = np.unique((shape % np.uint64(half - 1)).astype(np.int64), return_counts=True)
    wv = np.sqrt(wn / len(h))
    return (np.concatenate([w, half + 1 + s, [half]]),
            np.concatenate([0.5 * wv / np.sqrt((wv ** 2).sum()), 3 * sn / len(h), [3 * same]]))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int, rounds: int = 120,
               l2: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels: full-batch AdaGrad."""
    w, b = np.zeros(dims), 0.0
    if not rows:
        return Scorer(w, b)
    slot, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    g2, b2 = np.full(dims, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[slot] * val, minlength=len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(slot, err[row] * val, minlength=dims) / len(rows) + l2 * w
        gb = err.mean()
        g2 += g * g
        b2 += gb * gb
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * gb / np.sqrt(b2)
    return Scorer(w, float(b))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def fit_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 1500,
                dims: int = 1 << 15, seed: int = 5) -> QualityModel:
    """Label model over all documents and scorer over the bounded sample."""
    src = df.select(F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.xxhash64(F.lit(seed), "_text"))

    def vote(cols):
        got = [measures(t) for t in binary_list(cols["_text"])]
        return {"_key": cols["_key"], "pattern": [-1 if g is None else pattern_code(votes(g[1])) for g in got]}

    voted = arrow_map(src, vote, "_key bigint, pattern int").filter("pattern >= 0")
    frame = voted.groupBy("_key", "pattern").agg(F.count(F.lit(1)).alias("n"))
    frame = cut(frame)
    counts = frame.groupBy("pattern").agg(F.sum("n").alias("n")).collect()      # at most 3^9 rows
    if not counts:
        return QualityModel(LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), Scorer(np.zeros(dims), 0.0))
    codes = np.array([r["pattern"] for r in counts], np.int64)
    v, n = pattern_votes(codes), np.array([r["n"] for r in counts], float)
    model = fit_label_model(v, n)
    post = model.posterior(v)
    picks = None
    for side in (codes[post >= 0.5], codes[post < 0.5]):
        if len(side):
            got = frame.filter(F.col("pattern").isin(side.tolist())).orderBy("_key").limit(train_rows)
            picks = got if picks is None else picks.unionByName(got)
    value = F.create_map(*[F.lit(x) for c, p in zip(codes.tolist(), post.tolist()) for x in (c, p)])

    def feats(cols):
        got = [features(t, dims) for t in binary_list(cols["_text"])]
        return {"target": cols["target"], "slot": [g[0].astype("<i4").tobytes() for g in got],
                "val": [g[1].astype("<f4").tobytes() for g in got]}

    picked = (src.join(F.broadcast(picks.select("_key", value[F.col("pattern")].alias("target"))), "_key")  # 2 * train_rows
              .dropDuplicates(["_key"]).select("_text", "target"))
    rows = arrow_map(picked, feats, "target double, slot binary, val binary").collect()
    rows.sort(key=lambda r: (r["target"], bytes(r["slot"]), bytes(r["val"])))
    scorer = fit_scorer([(np.frombuffer(r["slot"], "<i4"), np.frombuffer(r["val"], "<f4").astype(float)) for r in rows],
                        np.array([r["target"] for r in rows]), dims)
    return QualityModel(model, scorer)


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """(id, score, kept) of every document, one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn(cols):
        got = np.array([shared.value.scorer.score(t) for t in binary_list(cols["_text"])], float)
        return {id_col: cols[id_col], "score": got, "kept": got >= threshold}

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    return arrow_map(src, fn, f"`{id_col}` {kind}, score double, kept boolean")


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents that the scorer keeps, all columns as they were."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            col = binary_list(b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array([shared.value.scorer.score(t) >= threshold for t in col], pa.bool_()))

    return df.mapInArrow(run, df.schema)
