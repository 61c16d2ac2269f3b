"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 400 bytes. A passage is encoded as the shares of its byte kinds and of runs of
three coarse kinds, then by a learned layer. Gated attention (a tanh gate times a sigmoid gate) weighs the
passages, and the weighted mean of their codes is scored by a logistic unit. Only documents are labelled; which
passages matter is learned from those labels alone.

Fitting: on at most `most_per_class` labelled documents of each class (a documented bound; those with the
smallest hash of the id), in one task, whole texts, seeded, so the same rows give the same model. Scoring covers
every passage of every document. Labels, language, source and id are no inputs of
a score, nor are the texts beside it: it is a function of the text and the model, to the last bit.

Rows: a null or empty text is one passage of nothing and gets a score like any other. Labels that repeat an id
count once, as the largest. A label without a document, or null, is left out. Without labels, or with one class
only, every score is the share of good labels (0.5 without any). An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S

PASSAGE, CODE, GATE = 400, 24, 12
# Kinds of bytes: each ASCII mark its own, then lower, upper, digit, space, line feed, other white space, control,
# lead and tail bytes of wider characters. Coarse kinds: lower, upper, digit, space, line feed, mark, wide, other.
_FINE, _COARSE = np.zeros(256, np.int64), np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _FINE[_b], _COARSE[_b] = 7 + (_b >= 192), 6
    elif _c.isalnum():
        _FINE[_b] = _COARSE[_b] = 2 if _c.isdigit() else int(_c.isupper())
    elif _b in _marks:
        _FINE[_b], _COARSE[_b] = 9 + _marks.index(_b), 5
    else:
        _FINE[_b] = {32: 3, 10: 4, 9: 5, 13: 5}.get(_b, 6)
        _COARSE[_b] = {32: 3, 10: 4}.get(_b, 7)
FINE = 9 + len(_marks)
WIDTH = FINE + 512


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (rows), and the offsets of the documents' passages."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(at[:-1], size) + (np.arange(len(data)) - np.repeat(off[:-1], size)) // PASSAGE
    fine = np.bincount(own * FINE + _FINE[data], minlength=at[-1] * FINE).reshape(-1, FINE)
    kind = _COARSE[data]
    runs = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
    row = np.repeat(np.arange(len(size)), size)
    inside = row[:-2] == row[2:]  # a run of three ends with its text
    runs = np.bincount((own[:-2] * 512 + runs)[inside], minlength=at[-1] * 512).reshape(-1, 512)
    total = np.maximum(1, fine.sum(1, keepdims=True))
    return np.sqrt(np.concatenate([fine, runs], 1) / total).astype(np.float32), at


def _grid(x: np.ndarray) -> np.ndarray:
    """Multiples of 2**-18 as doubles: sums of some thousand products of such numbers under 16 are exact, in whatever
    order a library adds them."""
    return np.round(np.asarray(x, np.float64) * 2**18) / 2**18


class Model:
    """Parameters by name; a model without parameters scores `prior` always."""

    def __init__(self, prior: float, weights: dict[str, np.ndarray] | None = None):
        self.prior, self.w, self.on_grid = prior, weights, {}

    def forward(self, x: np.ndarray, at: np.ndarray, w: dict[str, np.ndarray], grid: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[str, np.ndarray]:
        h = grid(np.tanh((x - w["mean"]) @ w["enc"] + w["enc0"]))
        tanh, gate = np.tanh(h @ w["att_v"]), 1 / (1 + np.exp(-np.clip(h @ w["att_u"], -30, 30)))
        e = grid(tanh * gate) @ w["att"]
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[own])
        a = e / np.add.reduceat(e, at[:-1])[own]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip((z * w["out"]).sum(1) + w["out0"], -30, 30)))
        return {"h": h, "tanh": tanh, "gate": gate, "a": a, "own": own, "z": z, "p": p}

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One score a text. Features, weights and codes are taken on a grid, so that a score does not depend on
        what is scored beside it."""
        if self.w is None:
            return np.full(len(at) - 1, self.prior)
        if not self.on_grid:
            self.on_grid = {k: _grid(v) for k, v in self.w.items()}
        return self.forward(_grid(x), at, self.on_grid, _grid)["p"]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prior=np.array(self.prior), **(self.w or {}))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        z = dict(np.load(io.BytesIO(raw)))
        prior = float(z.pop("prior"))
        return cls(prior, z or None)


def fit_bags(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, seed: int = 11) -> Model:
    """Adam on the log loss, classes weighted alike."""
    prior = float(y.mean()) if len(y) else 0.5
    if not 0 < prior < 1:
        return Model(prior)
    rng = np.random.default_rng(seed)
    mean = np.mean([b.mean(0) for b in bags], axis=0)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"enc": 3 * f(WIDTH, CODE), "enc0": np.zeros(CODE, np.float32), "att_v": f(CODE, GATE), "att_u": f(CODE, GATE), "att": f(GATE), "out": f(CODE), "out0": np.zeros((), np.float32), "mean": mean.astype(np.float32)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    model, step = Model(prior, w), 0
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = np.concatenate([bags[k] for k in pick])
            at = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])])
            s = model.forward(x, at, w)
            d = (s["p"] - y[pick]) * weight[pick] / len(pick)
            g = {"out": s["z"].T @ d, "out0": d.sum()}
            dz = d[:, None] * w["out"]
            dzo = dz[s["own"]]
            da = (dzo * s["h"]).sum(1)
            de = s["a"] * (da - np.add.reduceat(s["a"] * da, at[:-1])[s["own"]])
            both = s["tanh"] * s["gate"]
            g["att"] = both.T @ de
            db = de[:, None] * w["att"]
            dv, du = db * s["gate"] * (1 - s["tanh"] ** 2), db * s["tanh"] * s["gate"] * (1 - s["gate"])
            g["att_v"], g["att_u"] = s["h"].T @ dv, s["h"].T @ du
            dh = (s["a"][:, None] * dzo + dv @ w["att_v"].T + du @ w["att_u"].T) * (1 - s["h"] ** 2)
            g["enc"], g["enc0"] = (x - w["mean"]).T @ dh + 1e-5 * w["enc"], dh.sum(0)
            step += 1
            for k, grad in g.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v2[k] = 0.999 * v2[k] + 0.001 * grad * grad
                w[k] = (w[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4 (a null id as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_per_class: int = 2000) -> Model:
    """Learn from labelled rows that are not held out."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_per_class) for y in (0, 1)]
    rows = S.documents(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        bags = []
        for x in pdf["text"]:
            data = np.frombuffer((x or "").encode(), np.uint8)
            bags.append(passages(data, np.array([0, len(data)]))[0])
        return pd.DataFrame({"model": [fit_bags(bags, pdf["y"].to_numpy().astype(np.float32)).dump()]})

    found = rows.groupBy().applyInPandas(train, "model binary").collect()
    return Model.load(bytes(found[0].model)) if found else Model(0.5)


def score(text: Column, model: Model) -> Column:
    """The score of a text column, 0 to 1."""
    raw = model.dump()

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.load(raw)
        for col in texts:
            data, off = S.byte_column(pa.record_batch([col], names=["text"]), "text")
            out = []
            for i, j in S.chunks(off, S.CHUNK):
                out.append(m.scores(*passages(data[off[i] : off[j]], off[i : j + 1] - off[i])))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
        S.trim()

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if the score reaches the threshold)."""
    model = fit(docs, labels, label)
    scored = S.documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
