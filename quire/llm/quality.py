"""Quality classifier by co-training of two views of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.store import hash_sample, stored
from quire.llm.words import hashed_words, slices

c = F.col
BUCKETS = 1 << 11  # of the content view's character trigrams
NAMES = 16  # of languages and of sources, each
RESULT = "content_score double, metadata_score double, quality_score double, keep boolean"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, rows.offset * 8)
    data = np.frombuffer(rows.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def content_view(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams and, last, how short the text is; a row per text."""
    data, offsets = _bytes(texts)
    n = len(offsets) - 1
    if len(data) < 3:
        return np.hstack([np.zeros((n, BUCKETS)), np.ones((n, 1))]).astype(np.float32)
    wide = data.astype(np.uint32)
    bucket = (((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 11)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-2] == row[2:]
    counts = np.bincount(row[:-2][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    return np.hstack([np.sqrt(counts / np.maximum(total, 1)), np.sqrt(50 / (50 + total))]).astype(np.float32)


def metadata_view(texts: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """Where a page comes from and how it is laid out, without its words: a row per text."""
    data, offsets = _bytes(texts)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    lines = count(data == 10) + 1
    words, row = hashed_words(texts)
    n_words = np.maximum(np.bincount(row, minlength=n), 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    other = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122)) & (data != 44) & (data != 46)
    shape = np.column_stack([
        np.log1p(size), np.log1p(lines), np.log1p(size / lines), size / n_words / 10,
        4 * count(upper) / size, 4 * count(digit) / size, 8 * count(other) / size, 8 * count(data == 124) / size,
        2 * np.bincount(row[same], minlength=n) / n_words,
    ])

    def named(names: pa.Array) -> np.ndarray:
        out = np.zeros((n, NAMES))
        for i, x in enumerate(names.to_pylist()):
            out[i, 0 if x is None else 1 + sum(x.encode()) % (NAMES - 1)] = 1
        return out

    return np.hstack([shape, named(lang), named(source)]).astype(np.float32)


def logistic(
    x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 200, ridge: float = 1e-4, even: bool = True,
) -> np.ndarray:
    """Weights and, last, bias of a logistic regression by accelerated gradient steps.

    With ``even`` both classes weigh the same.
    """
    w = np.zeros(x.shape[1] + 1, x.dtype) if start is None else start.copy()
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if even else 0.5
    weight = (np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)).astype(x.dtype)
    step = 1.0 / (0.25 * (weight @ np.einsum("ij,ij->i", x, x) + 1) + ridge)
    ahead, before = w.copy(), w
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        miss = weight * (p - y).astype(x.dtype)
        w = ahead - (step * (np.append(miss @ x, miss.sum()) + ridge * np.append(ahead[:-1], 0))).astype(x.dtype)
        ahead, before = w + i / (i + 3) * (w - before), w
    return w


def scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and shift that calibrate the logits ``z``."""
    a, b = 1.0, 0.0
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - aim) * z).sum(), (p - aim).sum()])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


@dataclass(frozen=True)
class Model:
    """Both views' weights, centred and scaled metadata, and their calibration.

    ``content`` is None if the labels had one class only or none; every document
    then has the score ``prior``.
    """

    prior: float
    content: np.ndarray | None = None
    metadata: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    calibration: tuple = ((1.0, 0.0), (1.0, 0.0))
    join: np.ndarray | None = None

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of either view and of both, joined by their logits."""
        if self.content is None:
            same = np.full(len(content), self.prior)
            return same, same, same
        z = [content @ self.content[:-1] + self.content[-1],
             (metadata - self.centre) / self.spread @ self.metadata[:-1] + self.metadata[-1]]
        logits = np.column_stack([np.clip(a * x + b, -8, 8) for x, (a, b) in zip(z, self.calibration, strict=True)])
        both = logits @ self.join[:-1] + self.join[-1]
        one, two, both = (1 / (1 + np.exp(-x)) for x in (*logits.T, both))
        return one, two, both


def co_train(
    content: np.ndarray, metadata: np.ndarray, label: np.ndarray, rounds: int = 4, share: float = 0.1, sure: float = 0.9,
) -> Model:
    """Trains the two views on labels (0, 1; NaN: none) and on what the other one is sure of.

    A fifth of the labelled rows is kept for calibration. In every round each
    view hands the other the rows without label it is surest of: at most
    ``share`` of them, in the proportion of the classes, and only with a
    probability of ``sure`` or more. The kept rows calibrate each view and weigh
    the two against each other.
    """
    given = np.flatnonzero(~np.isnan(label))
    if not len(given) or label[given].min() == label[given].max():
        return Model(prior=float(label[given].mean()) if len(given) else 1.0)
    centre, spread = metadata.mean(axis=0), metadata.std(axis=0) + 0.05
    views = [content, (metadata - centre) / spread]
    held = given[np.arange(len(given)) % 5 == 4]
    base = np.setdiff1d(given, held)
    if len({*label[base]}) < 2 or len({*label[held]}) < 2:  # too few rows to hold any back
        held = base = given
    free = np.flatnonzero(np.isnan(label))
    taught = [np.full(len(label), np.nan), np.full(len(label), np.nan)]
    for t in taught:
        t[base] = label[base]
    weights: list = [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = np.flatnonzero(~np.isnan(taught[v]))
            weights[v] = logistic(views[v][rows], taught[v][rows], weights[v], 60 if turn else 300)
        if turn == rounds or not len(free):
            break
        good = label[base].mean()
        for v in (0, 1):
            other = taught[1 - v]
            left = free[np.isnan(other[free])]
            p = 1 / (1 + np.exp(-np.clip(views[v][left] @ weights[v][:-1] + weights[v][-1], -30, 30)))
            for value, chance, part in ((1.0, p, good), (0.0, 1 - p, 1 - good)):
                most = max(1, int(share * part * len(free)))
                best = np.argsort(-chance, kind="stable")[:most]
                other[left[best[chance[best] >= sure]]] = value
    z = [views[v][held] @ weights[v][:-1] + weights[v][-1] for v in (0, 1)]
    calibration = tuple(scale(x, label[held]) for x in z)
    logits = np.column_stack([np.clip(a * x + b, -8, 8) for x, (a, b) in zip(z, calibration, strict=True)])
    join = logistic(logits, label[held], rounds=500, ridge=1e-2, even=False)
    return Model(float(label[given].mean()), weights[0], weights[1], centre, spread, calibration, join)


def shares(sizes: dict[float, int], most: int) -> dict[float, int]:
    """How many of ``most`` rows each class gets: its share, but a tenth at least if it has as many."""
    total = sum(sizes.values())
    if total <= most or len(sizes) < 2:
        return {k: min(n, most) for k, n in sizes.items()}
    rare = min(sizes, key=lambda k: (sizes[k], k))
    few = min(sizes[rare], max(1, most // 10, round(most * sizes[rare] / total)))
    return {k: few if k == rare else most - few for k in sizes}


def _fit_columns(df: DataFrame, doc_id: str, text: str, lang: str, source: str) -> list:
    name = lambda x: c(x).cast("string") if x in df.columns else F.lit(None).cast("string")
    return [c(doc_id).cast("long").alias("_id"), c(text).alias("_text"), name(lang).alias("_lang"), name(source).alias("_source")]


def fit(
    df: DataFrame, labels: DataFrame, most_labelled: int = 3000, most_pool: int = 3000, seed: int = 11,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality",
) -> Model:
    """Fits on at most ``most_labelled`` labelled and ``most_pool`` other documents.

    Both samples are drawn by a hash of the id over the whole tables, the labelled
    one per class (:func:`shares`). A document labelled several times has the label
    that most of its rows give, 1 on a tie. Of rows that repeat a sampled id the one
    with the least features counts. Null ids and labels are ignored.
    """
    known = labels.where(c(doc_id).isNotNull() & c(label).isNotNull()).groupBy(c(doc_id).cast("long").alias("_id")).agg(
        F.when(F.avg(c(label).cast("double")) >= 0.5, 1.0).otherwise(0.0).alias("_label"))
    ids = df.select(c(doc_id).cast("long").alias("_id")).where("_id is not null").distinct()
    by_hash = (F.xxhash64("_id", F.lit(seed)), c("_id"))
    given = stored(known.join(ids, "_id", "left_semi"), "given")
    sizes = {r["_label"]: r["count"] for r in given.groupBy("_label").count().collect()}
    asked = given.limit(0)
    for value, most in shares(sizes, most_labelled).items():
        asked = asked.unionByName(hash_sample(given.where(c("_label") == value), most, *by_hash))
    others = hash_sample(ids.join(known, "_id", "left_anti"), most_pool, *by_hash).withColumn("_label", F.lit(None).cast("double"))
    sample = stored(asked.unionByName(others), "sample")  # at most the two limits, so it may be broadcast
    rows = df.select(*_fit_columns(df, doc_id, text, lang, source)).join(F.broadcast(sample), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last in slices(b.column("_text"), 1 << 20):
                part = b.slice(first, last - first)
                content = content_view(part.column("_text"))
                metadata = metadata_view(*(part.column(x) for x in ("_text", "_lang", "_source")))
                some = [np.flatnonzero(x).astype(np.uint16) for x in content]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_label"), pa.array([x.tobytes() for x in some], pa.binary()),
                    pa.array([content[i, x].tobytes() for i, x in enumerate(some)], pa.binary()),
                    pa.array([x.tobytes() for x in metadata], pa.binary()),
                ], ["_id", "_label", "at", "value", "meta"])

    found = rows.mapInArrow(features, "_id long, _label double, at binary, value binary, meta binary")
    least = found.groupBy("_id").agg(F.min(F.struct("meta", "at", "value", "_label")).alias("row")).select("_id", "row.*")
    table = stored(least, "features").toPandas().sort_values("_id")
    if not len(table):
        return Model(prior=1.0)
    content = np.zeros((len(table), BUCKETS + 1), np.float32)
    for i, (at, value) in enumerate(zip(table["at"], table["value"], strict=True)):
        content[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    metadata = np.array([np.frombuffer(x, np.float32) for x in table["meta"]])
    return co_train(content, metadata, table["_label"].to_numpy(np.float64))


def score(
    df: DataFrame, model: Model, threshold: float = 0.5,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """The columns of ``df`` with ``content_score, metadata_score, quality_score, keep``.

    Every row is scored on its whole text; ``keep`` says whether the combined
    score reaches the threshold. A null text counts as empty, a null language or
    source as one of its own, a missing such column as null. Columns named like
    a result are replaced. Without labels of both classes all rows get the share
    of good labels, 1 if there are none.
    """
    new = StructType.fromDDL(RESULT).fields
    extra = [x for x in df.columns if x not in {f.name for f in new}]
    helpers = _fit_columns(df, doc_id, text, lang, source)[1:]
    rows = df.select(F.struct(*(F.col(f"`{x}`") for x in extra if x != text)).alias("_row"), *helpers)
    schema = StructType([*rows.schema.fields[:2], *new])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights and a few more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for first, last in slices(b.column("_text"), 1 << 20):
                part = b.slice(first, last - first)
                texts = part.column("_text")
                found = own.scores(content_view(texts), metadata_view(texts, part.column("_lang"), part.column("_source")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), texts, *(pa.array(x, pa.float64()) for x in found), pa.array(found[2] >= threshold)],
                    ["_row", "_text", *(f.name for f in new)])

    done = rows.mapInArrow(run, schema)
    return done.select(
        *((c("_text") if x == text else c("_row").getField(x)).alias(x) for x in extra), *(f.name for f in new))
