"""Scalar functions as column expressions; everything here stays in the JVM unless it says otherwise."""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
LOG_LOSS_EPS = 1e-7


def sanitize(x: Column) -> Column:
    """Non-numbers, infinities and NaN become 0.0, for use on numeric and on text columns alike."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def log1p_abs(x: Column) -> Column:
    return F.log1p(F.abs(x))


def standardise(x: Column, mean: Column | float, scale: Column | float, eps: float = 1e-12) -> Column:
    """(x - mean) / scale; a scale nearer to zero than ``eps`` counts as ``eps`` with its sign."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    return (x - m) / F.when(F.abs(s) < eps, F.when(s < 0, -eps).otherwise(eps)).otherwise(s)


def zscore_clip(x: Column, mean: Column, std: Column, z: float = 3.0) -> Column:
    """Clip at ``z`` standard deviations, where the deviation exceeds 1e-6."""
    return F.when(std > 1e-6, F.greatest(F.least(x, mean + std * z), mean - std * z)).otherwise(x)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors."""
    return dot(l2_normalise(a), l2_normalise(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, gamma: float | Column) -> Column:
    g = gamma if isinstance(gamma, Column) else F.lit(gamma)
    return F.exp(-g * squared_distance(a, b))


def path_normaliser(n: Column) -> Column:
    """Expected path length of an unsuccessful search in a binary tree of n rows."""
    m = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(m - 1) + EULER_GAMMA) - 2 * (m - 1) / m)


def path_normaliser_py(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def anomaly_score(mean_path: Column, rows_per_tree: Column) -> Column:
    """-2 ** (-mean path / normaliser); low is anomalous; 0 where the normaliser is 0."""
    c = path_normaliser(rows_per_tree)
    return F.when(c <= 0, 0.0).otherwise(-F.pow(F.lit(2.0), -mean_path / c))


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def hash_bucket(token: Column, buckets: int) -> Column:
    """Bucket of a token: the first md5 byte modulo a power of two up to 256."""
    if buckets & (buckets - 1) or not 0 < buckets <= 256:
        raise ValueError("buckets must be a power of two up to 256")
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int") % buckets


def hash_sign(token: Column) -> Column:
    """+1 or -1 by the parity of the first sha1 byte (even: +1)."""
    return F.when(F.conv(F.substring(F.sha1(token), 1, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def stable_json_hash(value: object) -> str:
    """First 16 hex digits of the SHA-256 of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def json_hash(*fields: Column) -> Column:
    """:func:`stable_json_hash` of a row's fields (named columns, in order of their names) as one JSON object."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, 16)


def fnv1a(data: bytes, bits: int = 32) -> int:
    """The public FNV-1a hash of 32 or 64 bits, for checksums of binary files."""
    h, prime = (0x811C9DC5, 0x01000193) if bits == 32 else (0xCBF29CE484222325, 0x100000001B3)
    for b in data:
        h = ((h ^ b) * prime) & ((1 << bits) - 1)
    return h


def fnv1a_udf(bits: int = 32):
    """FNV-1a of a binary column as a batch function, all rows of a batch in lock step; the 64-bit hash as a signed long."""

    @F.pandas_udf("long")
    def run(col: pd.Series) -> pd.Series:
        data = [bytes(x) if x is not None else b"" for x in col]
        length = np.array([len(d) for d in data])
        offsets = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        flat = np.frombuffer(b"".join(data), np.uint8)
        h = np.full(len(data), 0x811C9DC5 if bits == 32 else 0xCBF29CE484222325, np.uint64)
        prime = np.uint64(0x01000193 if bits == 32 else 0x100000001B3)
        order = np.argsort(-length, kind="stable")
        for t in range(int(length.max()) if len(length) else 0):
            live = order[: np.searchsorted(-length[order], -t, "left")]
            h[live] = (h[live] ^ flat[offsets[live] + t].astype(np.uint64)) * prime
            if bits == 32:
                h[live] &= np.uint64(0xFFFFFFFF)
        return pd.Series(h.view(np.int64)).where(col.notna().to_numpy())

    return run


def sanitize_name(x: Column, default: str = "run") -> Column:
    """Characters outside [A-Za-z0-9_-] become ``_``; nothing left gives the default."""
    s = F.regexp_replace(F.trim(x), "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(s) == 0, F.lit(default)).otherwise(s)


def is_numeric(x: Column) -> Column:
    return F.trim(x).try_cast("double").isNotNull()


def json_number(doc: Column, key: str) -> Column:
    """A number under ``key``, flat or as {"value": number}."""
    return F.coalesce(F.get_json_object(doc, f"$.{key}.value").try_cast("double"), F.get_json_object(doc, f"$.{key}").try_cast("double"))


def replace_json_number(text: str, key: str, value: float) -> str:
    """The text with the first number under ``key`` replaced in place, all else untouched."""
    return re.sub(rf'("{re.escape(key)}"\s*:\s*)-?[0-9.eE+-]+', lambda m: m[1] + repr(value), text, count=1)


def json_number_replaced(doc: Column, key: str, value: Column) -> Column:
    """The text with numbers under ``key`` replaced in place, all else untouched."""
    return F.regexp_replace(doc, F.lit(rf'("{re.escape(key)}"\s*:\s*)-?[0-9.eE+-]+'), F.concat(F.lit("$1"), value.cast("string")))


def bit_length(x: Column) -> Column:
    """Bits that a non-negative integer needs; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def has_flag(x: Column, mask: int) -> Column:
    return (x.bitwiseAND(F.lit(mask)) != 0).cast("int")


def bit_field(x: Column, low: int, width: int) -> Column:
    return F.shiftright(x, low).bitwiseAND(F.lit((1 << width) - 1))


def with_bit_field(x: Column, value: Column, low: int, width: int) -> Column:
    mask = ((1 << width) - 1) << low
    return x.bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit((1 << width) - 1)), low))


def to_fixed_point(x: Column, fraction_bits: int, truncate: bool = False) -> Column:
    """x * 2**bits as an integer, rounded half away from zero or cut towards zero."""
    y = x * F.lit(float(1 << fraction_bits))
    return (F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)) if truncate else F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5))).cast("long")


def from_fixed_point(x: Column, fraction_bits: int) -> Column:
    return x.cast("double") / F.lit(float(1 << fraction_bits))


def scaled_integer(x: Column, scale: Column) -> Column:
    """round(x * scale), half away from zero, saturating at 64 bits."""
    y = x * scale
    r = F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5))
    return F.when(y >= 9.223372036854775e18, F.lit(9223372036854775807)).when(y <= -9.223372036854775e18, F.lit(-9223372036854775808)).otherwise(r.cast("long"))


def pad_array(a: Column, size: int, fill: float = 0.0) -> Column:
    """The first ``size`` entries, filled up at the end."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a))


def array_std(a: Column) -> Column:
    """Population standard deviation; 0 for an empty array."""
    m = array_mean(a)
    return F.sqrt(array_mean(F.transform(a, lambda x: (x.cast("double") - m) * (x.cast("double") - m))))


def count_members(a: Column, names: list[str]) -> Column:
    """Entries of an array that are in a fixed set; repeated entries count."""
    return F.size(F.filter(a, lambda x: x.isin(names)))


def log10_floor(x: Column, floor: float = 1e-4) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def uniform(seed: int, *key: Column | str) -> Column:
    """A reproducible uniform draw in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)).cast("double") / float(1 << 53)


def bounded_draw(seed: int, bound: int, *key: Column | str) -> Column:
    """A reproducible draw from 0 to ``bound`` - 1 for each key, all equally likely to within 2**-53."""
    return F.floor(uniform(seed, *key) * F.lit(float(bound))).cast("long")


def as_ratio(x: Column) -> Column:
    """Values above 1 are per cent."""
    return F.when(x > 1, x / 100.0).otherwise(x)


def ratio_of(value: float) -> float:
    """Configuration values above 1 are per cent."""
    return value / 100.0 if value > 1 else value


#: Names and aliases of metrics; fixed values.
METRIC_ALIASES = {"accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1_score", "f1_score": "f1_score", "fpr": "fpr", "tpr": "tpr", "auc": "roc_auc", "roc_auc": "roc_auc", "ap": "average_precision", "auprc": "average_precision", "average_precision": "average_precision", "logloss": "logloss", "mlogloss": "mlogloss", "mae": "mae", "mse": "mse", "rmse": "rmse", "mape": "mape", "r2": "r2"}
LOWER_IS_BETTER = {"fpr", "logloss", "mlogloss", "mae", "mse", "rmse", "mape"}
DEFAULT_METRIC = {"classification": "accuracy", "regression": "rmse", "isolation": "roc_auc"}


def metric_name(name: str) -> str:
    key = name.strip().lower()
    if key not in METRIC_ALIASES:
        raise ValueError(f"unknown metric {name!r}")
    return METRIC_ALIASES[key]


def better(name: str, a: float, b: float) -> bool:
    """Whether a is strictly better than b."""
    return a < b if metric_name(name) in LOWER_IS_BETTER else a > b
