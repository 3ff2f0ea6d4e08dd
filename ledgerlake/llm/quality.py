"""Quality classifier by hierarchical empirical Bayes (operator 4).

A document classifier gives the evidence of each text alone: logistic regression over shares of pairs of neighbouring
byte classes. Hosts and their paths have rates of good documents, from sums of that evidence; each is shrunk towards the
level above, hosts to the global rate and paths to their host, the more the fewer documents it has. How strongly is
estimated from the spread between sites. A document's posterior is its evidence with the prior moved from the global
rate to that of its path, which leaves its own evidence out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, fresh, lookup, staged, table

#: Labelled rows that the document classifier is fitted on: those with the least hash.
TRAIN_ROWS = 8000
#: Evidence is kept in whole parts of UNIT, so that sums don't depend on their order.
UNIT = 1_000_000
#: Bounds of a document's evidence and of a site's rate; bytes that are counted at once.
EDGE, RATE_EDGE, BLOCK = 1e-4, 1e-3, 4 << 20
GROUPS = (b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!?", b"*#$%&@^~", b"|<>{}[]\\/=+", b"\"'()-_`")


def _byte_classes() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.uint8)
    for k, group in enumerate(GROUPS):
        out[list(group)] = k
    out[0x80:0xC0], out[0xC0:] = len(GROUPS) + 1, len(GROUPS) + 2
    return out


CLASSES = _byte_classes()
N_FEATURES = 256 + 1


def features(texts: pa.Array) -> np.ndarray:
    """Text by feature: the share of each pair of classes of neighbouring bytes (as a root), and the logarithm of the
    length. A null or empty text has only zeros."""
    out = np.zeros((len(texts), N_FEATURES))
    for i, x in enumerate(texts.cast(pa.large_binary())):
        raw = np.frombuffer(x.as_buffer() or b"", np.uint8)
        if len(raw) < 2:
            continue
        for k in range(0, len(raw) - 1, BLOCK):
            c = CLASSES[raw[k : k + BLOCK + 1]]
            out[i, :256] += np.bincount(c[:-1].astype(np.int64) * 16 + c[1:], minlength=256)
        out[i, :256] = np.sqrt(out[i, :256] / (len(raw) - 1))
        out[i, 256] = math.log(len(raw))
    return out


@dataclass(frozen=True)
class DocumentModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, texts: pa.Array) -> np.ndarray:
        z = ((features(texts) - self.mean) / self.scale) @ self.weights + self.bias
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), EDGE, 1 - EDGE)


def fit(labelled: DataFrame, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> DocumentModel:
    """Newton's method with a ridge, on at most ``rows`` rows of labelled: those of least hash, so reruns agree.
    Null labels don't count; with no labels, or of one kind, the evidence is that kind's rate (0.5 without any)."""
    bounded_batches(labelled.sparkSession)
    kept = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    kept = kept.withColumn("h", F.xxhash64("text", "y")).orderBy("h", "y").limit(rows)
    shares = kept.mapInArrow(_features_of, "y double, x array<double>").toPandas()
    y = shares["y"].to_numpy(np.float64) if len(shares) else np.empty(0)
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.5, EDGE), 1 - EDGE)
        return DocumentModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), math.log(rate / (1 - rate)))
    x = np.stack(shares["x"].to_numpy())
    order = np.lexsort((*x.T[:4], y))  # arrival order doesn't matter
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return DocumentModel(mean, scale, w[:-1], float(w[-1]))


def _features_of(batches):
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def evidence(model: DocumentModel, text: Column) -> Column:
    """The classifier's probability that a text is good, in whole parts of UNIT."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.rint(model.probability(texts) * UNIT).astype(np.int64))

    return of(text)


def concentration(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """How many documents' worth the prior counts: the moment estimate of a beta-binomial over the groups."""
    r = F.col(s) / F.col(n)
    m = groups.agg(
        F.sum(F.col(n) * F.pow(r - prior, F.lit(2.0)) / (prior * (1 - prior))), F.count(F.lit(1)),
        F.sum(n), F.sum(F.col(n).cast("double") * F.col(n)),
    ).first()
    if not m[1]:
        return 1.0
    spare = float(m[2]) - float(m[3]) / float(m[2]) - (m[1] - 1)
    rho = (float(m[0]) - (m[1] - 1)) / spare if spare > 0 else 0.5
    return round(1 / min(max(rho, 1e-3), 0.5) - 1, 3)


def _bounded(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(RATE_EDGE)), F.lit(1 - RATE_EDGE))


def sites(scored: DataFrame, host: str, path: str, ev: str) -> tuple[DataFrame, float, float]:
    """One row per path of scored: host, path, n_path, s_path (sum of evidence), host_rate (shrunk); the global rate;
    how many documents' worth a host's rate counts for its paths."""
    paths = scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n_path"), (F.sum(ev) / F.lit(float(UNIT))).alias("s_path"))
    hosts = scored.groupBy(host).agg(F.count(F.lit(1)).alias("n_host"), (F.sum(ev) / F.lit(float(UNIT))).alias("s_host"))
    total = scored.agg(F.sum(ev), F.count(F.lit(1))).first()
    base = min(max((total[0] or 0) / UNIT / total[1] if total[1] else 0.5, RATE_EDGE), 1 - RATE_EDGE)
    k_host = concentration(hosts, "n_host", "s_host", F.lit(base))
    hosts = hosts.withColumn("host_rate", _bounded((F.col("s_host") + k_host * base) / (F.col("n_host") + k_host))).drop("s_host")
    met = lookup(paths, hosts, [host], "n_host")
    return met, base, concentration(met, "n_path", "s_path", F.col("host_rate"))


def posterior(docs: DataFrame, model: DocumentModel, host: str, path: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with four more columns, whose names follow: evidence, the host's and the path's shrunk rate (this without the
    document itself) and the posterior probability of being good. Texts don't shuffle."""
    bounded_batches(docs.sparkSession)
    names = [fresh(docs, c) for c in ("evidence", "host_rate", "path_rate", "posterior")]
    ev = fresh(docs, "__ev")
    scored = docs.withColumn(ev, evidence(model, F.col(text_col)))
    site, base, k_path = sites(staged(scored.select(host, path, ev), "quality-evidence"), host, path, ev)
    site = site.select(host, path, "n_path", F.col("host_rate").alias(names[1]), F.col("s_path").alias(f"{ev}_s"), F.col("n_path").alias(f"{ev}_n"))
    met = lookup(scored, site, [host, path], "n_path")
    p = F.col(ev) / F.lit(float(UNIT))
    met = met.withColumn(names[0], p)
    met = met.withColumn(names[2], _bounded((F.col(f"{ev}_s") - p + k_path * F.col(names[1])) / (F.col(f"{ev}_n") - 1 + k_path)))
    odds = F.log(p / (1 - p)) + F.log(F.col(names[2]) / (1 - F.col(names[2]))) - F.lit(math.log(base / (1 - base)))
    met = met.withColumn(names[3], 1 / (1 + F.exp(-odds)))
    return met.select(*docs.columns, *(F.round(c, 6).alias(c) for c in names)), names


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of labelled documents, of TRAIN_ROWS labels at most: those of least hash. Repeated labels of a document
    count as their rounded mean; labels without a document don't count."""
    kept = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.round(F.avg(label_col)).alias("y"))
    kept = kept.orderBy(F.xxhash64("k"), "k").limit(rows)
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(kept), "k").select("text", "y")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with evidence, host_rate, path_rate, posterior and keep (posterior >= threshold).

    Null and empty texts have the evidence of a text without features; a null host or path is a site of its own; a
    host with one document gets nearly the global rate; repeated rows count as rows; no rows give no rows. New columns
    whose names docs has already get underscores.
    """
    model = fit(labelled(docs, labels, id_col, text_col), "text", "y")
    out, names = posterior(docs, model, host, path, text_col)
    return out.withColumn(fresh(docs, "keep"), F.col(names[3]) >= threshold)


def good_only(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that classify() keeps, with their columns."""
    out = classify(docs, labels, **how)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", "evidence", "host_rate", "path_rate", "posterior", "keep")
