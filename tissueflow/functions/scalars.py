"""Scalar functions on columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# The class labels of the segmentation.
CLASS_LABELS = {"Connective": 0, "Dead": 1, "Epithelial": 2, "Inflammatory": 3, "Neoplastic": 4, "Nolabel": -1}


def parse_tag(tag: Column) -> Column:
    """'a=1;b=HVG:1000' as a map."""
    return F.str_to_map(tag, F.lit(";"), F.lit("="))


def build_tag(params: Column, drop: Sequence[str] = ("data_dir", "save_dir_tag", "list_training_ids")) -> Column:
    """A map as 'k=v;k=v' in its own order, without the keys in drop."""
    keep = F.filter(F.map_entries(params), lambda e: ~e["key"].isin(*drop))
    return F.array_join(F.transform(keep, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def train_slide(train_ids: Column, fold: Column) -> Column:
    """The first training slide, unless a fold is given (not null)."""
    return F.when(fold.isNull(), train_ids[0])


def gene_spec(spec: Column) -> Column:
    """'HVG:1000' as method and n; a bare name has n null."""
    parts = F.split(spec, ":")
    return F.struct(parts[0].alias("method"), F.get(parts, F.lit(1)).cast("int").alias("n"))


def stable_int(s: Column) -> Column:
    """md5 modulo 10^8, from its hex digits eight at a time."""
    digits = F.md5(s)
    out = F.lit(0).cast("long")
    for k in range(4):
        out = (out * 4294967296 + F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")) % 100000000
    return out


def embedding_stem(path: Column) -> Column:
    """Key and sample of an embedding file's name, 'key_sample.ext'."""
    parts = F.split(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "_")
    return F.struct(parts[0].alias("key"), F.get(parts, F.lit(1)).alias("sample_id"))


def class_name(label: Column, classes: Mapping[str, int] = CLASS_LABELS) -> Column:
    """The class of a label; unknown labels are null."""
    pairs = [F.lit(x) for name, k in classes.items() for x in (k, name)]
    return F.try_element_at(F.create_map(*pairs), label)


def class_label(name: Column, classes: Mapping[str, int] = CLASS_LABELS) -> Column:
    pairs = [F.lit(x) for name_, k in classes.items() for x in (name_, k)]
    return F.try_element_at(F.create_map(*pairs), name)


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a scaled to length one; a zero vector gives null components."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def category_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """df with the place of each category among the sorted distinct ones, from 0; nulls have -1.

    Only distinct values meet in the one window.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    values = values.withColumn(code, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(values, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))


def nb_variance(mu: Column, theta: Column) -> Column:
    return mu + mu * mu / theta


def nb_from_logits(total_count: Column, logits: Column) -> Column:
    """mu and theta of the other parametrisation."""
    return F.struct((total_count * F.exp(logits)).alias("mu"), total_count.alias("theta"))


def nb_to_logits(mu: Column, theta: Column, eps: float = 1e-8) -> Column:
    return F.struct(theta.alias("total_count"), (F.ln(mu + eps) - F.ln(theta + eps)).alias("logits"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz), on the side where that converges fast."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    inside = (x > 0) & (x < 1)
    other = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(inside, np.where(other, 1 - x, x), 0.5), np.where(other, b, a), np.where(other, a, b)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / keep(1 - (p + q) * z / (p + 1))
    c, f = np.ones_like(z), d
    for m in range(1, rounds):
        step = np.ones_like(z)
        for t in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / keep(1 + t * d), keep(1 + t / c)
            step, f = c * d, f * c * d
        if np.all(np.abs(step - 1) < 1e-15):
            break
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) * f / p
    return np.where(np.isnan(x), np.nan, np.where(inside, np.where(other, 1 - front, front), np.clip(x, 0, 1)))


def correlation_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Pearson correlations of n pairs (Student's t with n - 2 degrees); nan for fewer than three pairs."""
    r, n = np.clip(np.asarray(r, dtype=float), -1, 1), np.asarray(n, dtype=float)
    return np.where(n > 2, incomplete_beta((1 - r) * (1 + r), np.maximum(n - 2, 1) / 2, np.full_like(n, 0.5)), np.nan)


@pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Null where the correlation is null or there are fewer than three pairs."""
    p = correlation_p_values(r.to_numpy(dtype=float), n.to_numpy(dtype=float))
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


def nb_log_prob_values(x: np.ndarray, mu: np.ndarray, theta: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    both = np.log(theta + mu + eps)
    return theta * (np.log(theta + eps) - both) + x * (np.log(mu + eps) - both) + _lgamma(x + theta) - _lgamma(theta) - _lgamma(x + 1)


@pandas_udf(DoubleType())
def nb_log_prob(x: pd.Series, mu: pd.Series, theta: pd.Series) -> pd.Series:
    """Log-probability of counts under a negative binomial (Spark has no ln gamma)."""
    return pd.Series(nb_log_prob_values(*(s.to_numpy(dtype=float) for s in (x, mu, theta))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def zinb_log_prob_values(x: np.ndarray, mu: np.ndarray, theta: np.ndarray, pi: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """pi: the logit of a dropped zero."""
    drop = theta * (np.log(theta + eps) - np.log(theta + mu + eps)) - pi
    zero = _softplus(drop) - _softplus(-pi)
    positive = nb_log_prob_values(x, mu, theta, eps) - pi - _softplus(-pi)
    return np.where(x < eps, zero, positive)


@pandas_udf(DoubleType())
def zinb_log_prob(x: pd.Series, mu: pd.Series, theta: pd.Series, pi: pd.Series) -> pd.Series:
    return pd.Series(zinb_log_prob_values(*(s.to_numpy(dtype=float) for s in (x, mu, theta, pi))))
