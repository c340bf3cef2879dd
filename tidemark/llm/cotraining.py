"""Quality classifier by co-training two views of a document.

The content view sees the text (hashed byte trigrams and single bytes); the metadata view sees source, language and layout
(lengths, line and word statistics).  Each view has its own logistic regression, fitted on a bounded sample of the labelled
documents (``max_labelled``, by hash of the id) and calibrated on a fold of it that no fit sees.  In every round
both views score all documents without a sampled label; up to ``per_round`` documents of each class that a view is sure of
(calibrated probability beyond ``sure``; equal texts count once, chosen by hash) become training rows of the *other*
view, and both are fitted again.  At the end the calibrated views are combined by a logistic regression on the
calibration fold, and all documents get a score.

Features are computed once over whole texts and stored; a round reads that table.  The driver holds models and training rows only: at
most max_labelled + 4 * rounds * per_round rows of FEATURES numbers.

Defined cases: null text is empty; null source and language are values of their own; several labels of one document count as
the lowest; null labels are none; without labels of both classes every score is the share of good labels (1.0 without any);
repeated rows get equal scores; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAMS = 512
CONTENT = 256 + GRAMS
NAMES = 64  # hashed places for source and language
LAYOUT = 12
META = NAMES + LAYOUT
FEATURES = CONTENT + META
SLICE = 1 << 20


def content_counts(data: bytes) -> np.ndarray:
    """Counts of bytes and hashed trigrams of a whole text, slice by slice."""
    out = np.zeros(CONTENT, np.float64)
    for i in range(0, len(data), SLICE):
        b = np.frombuffer(data[i : i + SLICE + 2], np.uint8).astype(np.uint32)
        out[:256] += np.bincount(b[:SLICE], minlength=256)[:256]
        if len(b) > 2:
            h = (b[:-2] * np.uint32(2654435761) ^ b[1:-1] * np.uint32(2246822519) ^ b[2:] * np.uint32(3266489917)) * np.uint32(668265263)
            out[256:] += np.bincount(h >> np.uint32(23), minlength=GRAMS)
    return out


def content_vector(data: bytes) -> np.ndarray:
    """Square-root frequencies in bytes (0 to 255), so that the vector of a document has CONTENT bytes."""
    c = content_counts(data)
    for part in (c[:256], c[256:]):
        if part.sum():
            part[:] = np.sqrt(part / part.sum())
    return np.minimum(255, np.round(c * 512)).astype(np.uint8)


def layout_vector(text: str, n_bytes: int) -> list[float]:
    """Lengths and shares; no words."""
    lines, words = text.split("\n"), text.split()
    n, w, ln = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    capitals = sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = sum(text.count(c) for c in "0123456789")
    stops = sum(text.count(c) for c in ".,;:!?")
    return [
        np.log1p(n_bytes) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, len(text) / w / 10, np.log1p(len(text) / ln) / 10,
        capitals / n * 4, digits / n * 4, stops / n * 4, len(set(words)) / w, len(set(lines)) / ln,
        text.count("\n\n") / ln, max(map(len, lines)) / n,
    ]


def _hash(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % NAMES


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, th, c, m): content vector (bytes) and metadata vector (floats) of every document."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(2)
                names = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
                c, m = [], []
                for t, (s, g) in zip(texts, names):
                    data = t.as_py() or ""
                    raw = data.encode()
                    c.append(content_vector(raw).tobytes())
                    v = np.zeros(META, np.float32)
                    for name in (f"s:{s}", f"l:{g}"):
                        v[_hash(name)] += 1
                    v[NAMES:] = layout_vector(data, len(raw))
                    m.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "th", "c", "m"])

    cols = [F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("g")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, th long, c binary, m binary")


def _matrix(rows: list[bytes], kind, scale: float) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float32) * scale


VIEWS = {"content": ("c", np.uint8, 1 / 64), "meta": ("m", np.float32, 1.0)}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a class-balanced logistic regression by accelerated gradient steps."""
    y = y.astype(np.float32)
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    v = np.random.RandomState(0).rand(z.shape[1]).astype(np.float32)
    for _ in range(15):  # the largest curvature sets the step
        v = z.T @ (weight * (z @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (0.25 * top * 1.1 + l2)
    w = np.zeros(z.shape[1], np.float32)
    u, t = w, 1.0
    for _ in range(steps):
        g = z.T @ (weight * (_sigmoid(z @ u) - y)) + l2 * np.append(u[:-1], np.float32(0))
        # plain floats keep the arrays in single precision
        new, nt = u - rate * g, (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / nt * (new - w), new, nt
    raw = w[:-1] / std
    return np.append(raw, w[-1] - raw @ mean).astype(np.float64)


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Platt scaling of one or several margins (columns): slopes and offset by Newton steps, targets drawn in a little."""
    x = np.column_stack([margins, np.ones(len(margins))])
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


class Models:
    """The two views and how they are calibrated and combined; a few hundred numbers."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.platt: dict[str, np.ndarray] = {}
        self.both: np.ndarray | None = None

    def margin(self, view: str, rows: list[bytes]) -> np.ndarray:
        _, kind, scale = VIEWS[view]
        w = self.weights[view]
        return _matrix(rows, kind, scale) @ w[:-1] + w[-1]

    def logit(self, view: str, rows: list[bytes]) -> np.ndarray:
        a, b = self.platt[view]
        return a * self.margin(view, rows) + b


def _scored(table: DataFrame, models: Models) -> DataFrame:
    """(doc_id, th, p_content, p_meta, p): calibrated views and, once there, their combination."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = [models.logit(v, batch.column(batch.schema.get_field_index(VIEWS[v][0])).to_pylist()) for v in VIEWS]
            both = np.column_stack([*logits, np.ones(len(logits[0]))]) @ models.both if models.both is not None else np.zeros(len(logits[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(_sigmoid(z), pa.float64()) for z in (*logits, both)]], ["doc_id", "th", "p_content", "p_meta", "p"])

    return table.select("doc_id", "th", "c", "m").mapInArrow(run, "doc_id long, th long, p_content double, p_meta double, p double")


def train(table: DataFrame, labels: DataFrame, key: str = "doc_id", max_labelled: int = 10_000, per_round: int = 500, rounds: int = 3, sure: float = 0.97) -> tuple[Models | None, float]:
    """Models from the stored feature ``table``; None with one class only, and the share of good labels."""
    lab = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("y"))
    sample = stored(lab.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_labelled))  # at most max_labelled rows of two numbers
    rows = table.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("th", "c", "m")).alias("f"), F.first("y").alias("y"), (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(5)) == 0).alias("hold"))
    got = rows.orderBy("doc_id").collect()
    y = np.array([r["y"] for r in got])
    hold = np.array([r["hold"] for r in got], bool)
    prior = float(y.mean()) if len(y) else 1.0
    if len(got) < 20 or min(y[~hold].sum(), (1 - y[~hold]).sum(), y[hold].sum(), (1 - y[hold]).sum()) < 1:
        return None, prior
    data = {v: [r["f"][VIEWS[v][0]] for r in got] for v in VIEWS}
    known = {v: [([r for r, h in zip(data[v], hold) if not h], y[~hold])] for v in VIEWS}
    kept = {v: [r for r, h in zip(data[v], hold) if h] for v in VIEWS}
    models = Models()

    def refit() -> None:
        for v in VIEWS:
            _, kind, scale = VIEWS[v]
            x = np.vstack([_matrix(r, kind, scale) for r, _ in known[v] if r])
            models.weights[v] = fit(x, np.concatenate([t for r, t in known[v] if r]))
            models.platt[v] = calibrate(models.margin(v, kept[v]), y[hold])

    refit()
    rest = table.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    taken: set[int] = set()  # text hashes of pseudo-labelled documents: at most 4 * rounds * per_round
    for at in range(rounds):
        scored = _scored(rest, models)
        new = 0
        for view, other in (("content", "meta"), ("meta", "content")):
            for label in (1, 0):
                p = F.col(f"p_{view}")
                sure_rows = scored.where(p >= sure if label else p <= 1 - sure).groupBy("th").agg(F.min("doc_id").alias("doc_id"))
                pick = [r["th"] for r in sure_rows.orderBy(F.xxhash64(F.lit(at), "th"), "th").limit(per_round + len(taken)).collect() if r["th"] not in taken][:per_round]
                if not pick:
                    continue
                picked = table.sparkSession.createDataFrame([(t,) for t in pick], "th long")
                vectors = rest.join(F.broadcast(picked), "th").groupBy("th").agg(F.min(VIEWS[other][0]).alias("x")).orderBy("th").collect()
                known[other].append(([r["x"] for r in vectors], np.full(len(vectors), label)))
                taken |= set(pick)
                new += len(pick)
        if not new:
            break
        refit()
    models.both = calibrate(np.column_stack([models.logit(v, kept[v]) for v in VIEWS]), y[hold])
    return models, prior


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.5, table: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for every document."""
    table = stored(features(docs, key)) if table is None else table
    models, prior = train(table, labels, key, **options)
    if models is None:
        p = F.lit(prior)
        out = table.select("doc_id", p.alias("p_content"), p.alias("p_meta"), p.alias("p"))
    else:
        out = _scored(table, models)
    return out.select(F.col("doc_id").alias(key), F.col("p_content").alias("text_score"), F.col("p_meta").alias("meta_score"), F.col("p").alias("score"), (F.col("p") >= threshold).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the quality score of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
