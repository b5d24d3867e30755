"""Operator 9, quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, release, slices, small_batches, unused

#: Bound on the labelled rows that a fit uses.
LABELLED = 4096
ROUNDS = 3
#: Pseudo-labels that a view hands to the other in a round, and how sure it must be.
HANDED, SURE = 192, 0.98

#: Byte classes: control, white space, digit, lower, upper, sentence mark, other mark, not ASCII.
CLASS = np.zeros(256, np.int64)
CLASS[[9, 10, 11, 12, 13, 32]] = 1
CLASS[48:58] = 2
CLASS[97:123] = 3
CLASS[65:91] = 4
CLASS[33:48] = CLASS[58:65] = CLASS[91:97] = CLASS[123:127] = 6
CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
CLASS[128:] = 7
#: Bytes counted at once.
BLOCK = 1 << 20
N_TEXT = 512 + 8 + 6
N_META = 1 + 16 + 32 + 24


def text_features(text: str | None) -> np.ndarray:
    """Shares of the trigrams of byte classes, and measures of repetition, over the whole text."""
    out = np.zeros(N_TEXT)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    codes = CLASS[np.frombuffer(data, np.uint8)] if len(data) <= BLOCK else None
    for k in range(0, len(data), BLOCK):
        c = codes if codes is not None else CLASS[np.frombuffer(data[k : k + BLOCK + 2], np.uint8)]
        out[:512] += np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=512)
        out[512:520] += np.bincount(c[:BLOCK], minlength=8)
    out[:512] /= max(1, len(data) - 2)
    out[512:520] /= len(data)
    out[:520] = np.sqrt(out[:520])
    words = data.lower().split()
    if words:
        n = len(words)
        lines = data.split(b"\n")
        same = sum(a == b for a, b in zip(words, words[1:]))
        out[520:] = len(set(words)) / n, np.log1p(n) / 10, same / n, np.sqrt(len(set(lines)) / len(lines)), len(data) / n / 20, np.log1p(n / len(lines)) / 5
    return out


def _bucket(value: str | None, n: int) -> int:
    import xxhash

    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value.encode(), 3) % (n - 1)


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Language, source and declared length, none of which looks at the text."""
    out = np.zeros(N_META)
    out[0] = 1
    out[1 + _bucket(lang, 16)] = 1
    out[17 + _bucket(source, 32)] = 1
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    out[49 + (1 + min(22, int(2 * np.log10(1 + n_chars))) if known else 0)] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 8) -> Logistic:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        a = np.ones((len(x), x.shape[1] + 1))
        np.subtract(x, mean, out=a[:, :-1])
        a[:, :-1] /= scale
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = _sigmoid(a @ w)
            v = np.maximum(p * (1 - p), 1e-4)
            w -= np.linalg.solve((a * v[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class CoTrained:
    """Two views with their calibration (slope, offset on the logit) and the share of good rows."""

    text: Logistic
    meta: Logistic
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: by both views as independent evidence, by text, by metadata."""
        t = self.text.logit(xt) * self.text_scale[0] + self.text_scale[1]
        m = self.meta.logit(xm) * self.meta_scale[0] + self.meta_scale[1]
        return _sigmoid(t + m - self.prior), _sigmoid(t), _sigmoid(m)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with his smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([1.0, 0.0])
    a = np.c_[z, np.ones(len(z))]
    for _ in range(30):
        p = _sigmoid(a @ w)
        v = np.maximum(p * (1 - p), 1e-6)
        w -= np.linalg.solve((a * v[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - goal) + 1e-3 * (w - [1.0, 0.0]))
    return (max(float(w[0]), 0.0), float(w[1]))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, surest, rounds: int = ROUNDS) -> CoTrained:
    """Fit both views on the labelled rows; in each round each view labels the other rows it is
    surest of, and the other learns them too; calibrate on a third of the labelled rows held back.

    surest(text, meta, counts) looks through all rows without a label: for each view and class the
    counts[class] different texts that the view is surest of, as (view, class, hash of the text,
    text features, metadata features).
    """
    held = np.arange(len(y)) % 3 == 2
    n, ly = int((~held).sum()), y[~held]
    given: dict[str, dict] = {"text": {}, "meta": {}}  # rows and labels that a view has been given, by hash
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    # each class gets pseudo-labels in proportion to its share of the labels
    counts = (max(1, round(HANDED * (1 - prior))), max(1, round(HANDED * prior)))
    # one table a view, with places for what it may be given: the driver holds no second copy for a fit
    tables = {name: np.empty((n + rounds * sum(counts), x.shape[1])) for name, x in (("text", xt), ("meta", xm))}
    for name, x in (("text", xt), ("meta", xm)):
        np.compress(~held, x, axis=0, out=tables[name][:n])

    def fits() -> tuple[Logistic, Logistic]:
        out = []
        for name, x in tables.items():
            more = [given[name][k] for k in sorted(given[name])]
            for i, (row, _) in enumerate(more, n):
                x[i] = row
            out.append(Logistic.fit(x[: n + len(more)], np.r_[ly, [m[1] for m in more]]))
        return out[0], out[1]

    text, meta = fits()
    for _ in range(rounds):
        for view, label, key, t, m in surest(text, meta, counts):
            if view == "text":
                given["meta"].setdefault(key, (m, float(label)))
            else:
                given["text"].setdefault(key, (t, float(label)))
        text, meta = fits()
    scales = [_calibrate(view.logit(x[held]), y[held]) for view, x in ((text, xt), (meta, xm))]
    return CoTrained(text, meta, scales[0], scales[1], float(np.log(prior / (1 - prior))))


def _best(sure: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The n surest of different keys, of those that are sure enough; ties by key."""
    order = np.lexsort((keys, -sure))
    order = order[sure[order] >= SURE]
    _, first = np.unique(keys[order], return_index=True)
    return order[np.sort(first)][:n]


def _meta_columns(df: DataFrame) -> list:
    kinds = dict(df.dtypes)
    return [(F.col(c).cast(t) if c in kinds else F.lit(None).cast(t)).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "double"))]


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-train on ``labelled`` labelled rows at most, those with the smallest hash of the key, and on
    what the views are surest of among all other rows, which every round looks through whole.

    Null keys and labels are ignored; a key with several labels takes their majority, good on a
    tie; of rows with one key, that with the smallest hash counts. Equal texts are one candidate for
    a pseudo-label. Only features of the labelled rows and of the surest ones reach the driver,
    some 4 KB a row, and labelled rows are held there once. None if there are fewer than three rows of either class.
    """
    good = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    ids = df.select(F.col(key).alias("k")).filter("k is not null").distinct()
    chosen = ids.join(good, "k").orderBy(F.xxhash64(F.lit(17), "k"), "k").limit(labelled)
    vectors = _features_udf()
    one = df.select(F.col(key).alias("k"), F.struct(F.col(text).alias("t"), *_meta_columns(df)).alias("d"))
    rows = one.join(F.broadcast(chosen), "k").groupBy("k").agg(F.first("y").alias("y"), F.min_by("d", F.xxhash64("d")).alias("d"))
    got = rows.select("k", "y", vectors("d.t", "d.lang", "d.source", "d.n_chars").alias("x")).toArrow().sort_by("k")
    y = got["y"].to_numpy()
    if min((y == 1).sum(), (y == 0).sum()) < 3:
        return None
    others = one.join(F.broadcast(chosen.select("k")), "k", "left_anti").select("d.*")
    # both classes in the same order in each third
    order = np.argsort(-y, kind="stable")
    x = np.empty((len(y), N_TEXT + N_META))
    for i, k in enumerate(order.tolist()):
        x[i] = np.frombuffer(zlib.decompress(got["x"][k].as_buffer()), np.float64)
    y, got = y[order], None
    release(df.sparkSession)
    model = co_train(x[:, :N_TEXT], x[:, N_TEXT:], y, lambda *a: _surest(others, *a), rounds)
    x = None
    release(df.sparkSession)
    return model


def _surest(others: DataFrame, text: Logistic, meta: Logistic, counts: tuple[int, int]) -> list[tuple]:
    """See co_train. Each task keeps the surest rows it meets; theirs are merged by a distributed sort."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        kept: dict[tuple, list] = {(v, c): [np.zeros(0), np.zeros(0, np.int64), np.zeros((0, N_TEXT + N_META))] for v in ("text", "meta") for c in (0, 1)}
        for b in slices(batches):
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            x = np.array([np.concatenate([text_features(t), meta_features(*m)]) for t, *m in rows])
            keys = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 5) >> 1 for t, *_ in rows], np.int64)
            for view, model, part in (("text", text, x[:, :N_TEXT]), ("meta", meta, x[:, N_TEXT:])):
                p = _sigmoid(model.logit(part))
                for c, sure in ((0, 1 - p), (1, p)):
                    mine = _best(sure, keys, counts[c])
                    all_ = [np.concatenate(y) for y in zip(kept[view, c], (sure[mine], keys[mine], x[mine]))]
                    top = _best(all_[0], all_[1], counts[c])
                    kept[view, c] = [y[top] for y in all_]
        for (view, c), (sure, keys, x) in kept.items():
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(keys)), pa.array([c] * len(keys), pa.int32()), pa.array(sure), pa.array(keys), pa.array([v.tobytes() for v in x], pa.binary())], ["view", "label", "sure", "key", "x"])

    with small_batches(others.sparkSession):
        kept = materialize(others.select("t", "lang", "source", "n_chars").mapInArrow(run, "view string, label int, sure double, key bigint, x binary"), "quality-surest")
    out = []
    for view in ("text", "meta"):
        for c in (0, 1):
            # a text that stands under several names has one key and several metadata: the surest counts
            part = kept.filter((F.col("view") == view) & (F.col("label") == c)).groupBy("key").agg(F.max(F.struct("sure", "x")).alias("r"))
            for r in part.orderBy(F.desc("r.sure"), "key").limit(counts[c]).collect():
                x = np.frombuffer(r["r"]["x"], np.float64)
                out.append((view, c, r["key"], x[:N_TEXT], x[N_TEXT:]))
    drop_scratch(kept)
    return out


def _features_udf():
    """A row's features, compressed: most are zero."""

    @F.pandas_udf("binary")
    def vectors(t: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(np.concatenate([text_features(a), meta_features(b, c, d)]).tobytes(), 1) for a, b, c, d in zip(t, lang, source, n)], dtype=object)

    return vectors


def score(df: DataFrame, model: CoTrained | None, text: str = "text") -> DataFrame:
    """Add ``scores``: struct of quality (both views), by_text and by_metadata, each the calibrated
    probability that the row is good.

    Text that is null or has no words scores 0 in quality and by_text. Columns lang, source and
    n_chars may be null or missing. Without a model all other rows score 1. The whole text counts,
    row by row, so groups and hot sources don't matter. Extra columns are kept; one named scores
    is replaced.
    """
    df = df.drop("scores")
    blank = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kind = "struct<quality:double,by_text:double,by_metadata:double>"
    if model is None:
        one = F.when(blank, 0.0).otherwise(1.0)
        return df.withColumn("scores", F.struct(one.alias("quality"), one.alias("by_text"), F.lit(1.0).alias("by_metadata")).cast(kind))

    @F.pandas_udf(kind)
    def rate(t: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = np.zeros((3, len(t)))
        for k in range(0, len(t), 512):
            part = slice(k, k + 512)
            xt = np.array([text_features(a) for a in t[part]])
            xm = np.array([meta_features(*a) for a in zip(lang[part], source[part], n[part])])
            out[:, part] = model.score(xt, xm)
        return pd.DataFrame(dict(zip(("quality", "by_text", "by_metadata"), out)))

    name = unused(df, "__r")
    rated = df.withColumn(name, rate.asNondeterministic()(F.col(text), *_meta_columns(df)))
    zero = lambda c: F.when(blank, F.lit(0.0)).otherwise(F.col(f"{name}.{c}")).alias(c)
    return rated.withColumn("scores", F.struct(zero("quality"), zero("by_text"), F.col(f"{name}.by_metadata").alias("by_metadata"))).drop(name)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Fit on the labels, score all rows, add ``keep``: quality is at least ``threshold``."""
    return score(df, fit(df, labels, key, text, label), text).withColumn("keep", F.col("scores.quality") >= threshold)
