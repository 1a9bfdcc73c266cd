"""Deterministic identities as column expressions, with scalar twins."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the namespace of stable uids.
NAMESPACE = uuid.UUID("b3e7a9f1-6c2d-4a8b-9f01-3d5e7a2b8c4f")
UNRESOLVED = "unresolved"


def make_uid() -> str:
    """A random 16-digit uid."""
    return uuid.uuid4().hex[:16]


def random_uid() -> Column:
    """A random uid for each row; write the result before using it twice."""
    return F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 16)


def make_stable_uid(*values: object) -> str:
    """The first 16 digits of the name-based uuid of the values joined by a bar."""
    return uuid.uuid5(NAMESPACE, "|".join(map(str, values))).hex[:16]


def stable_uid(*columns: Column) -> Column:
    """Column twin of ``make_stable_uid``; null if any value is null."""
    name = F.concat(*(x for i, c in enumerate(columns) for x in ([F.lit("|")] * (i > 0) + [c.cast("string")])))
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3))


def resolution_uid(value: Column, *identity: Column) -> Column:
    """Stable uid of the identity fields, or of the unresolved input where any of them is null."""
    return F.coalesce(stable_uid(*identity), stable_uid(F.lit(UNRESOLVED), value))


def layout_uid(uids: Column) -> Column:
    """Content address of an ordered array of feature uids: SHA-256 over each uid and a zero byte, 16 digits."""
    return F.substring(F.sha2(F.array_join(F.transform(uids, lambda u: F.concat(u, F.lit("\0"))), ""), 256), 1, 16)


def compute_layout_uid(uids: list[str]) -> str:
    """Scalar twin of ``layout_uid``."""
    return hashlib.sha256("".join(u + "\0" for u in uids).encode()).hexdigest()[:16]


@F.pandas_udf(T.StringType())
def dataset_perturbation_uid(dataset: pd.Series, perturbation: pd.Series) -> pd.Series:
    """16 digits of an 8-byte BLAKE2b digest of ``dataset_perturbation``; Spark has no BLAKE2."""
    return pd.Series([None if d is None or p is None else hashlib.blake2b(f"{d}_{p}".encode(), digest_size=8).hexdigest() for d, p in zip(dataset, perturbation, strict=True)])
