"""Digests: built-in MD5 and SHA-1/2; SHA-3 by an Arrow-batched UDF."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column, kind: str) -> Column:
    """Lower-case hex of md5, sha1, sha256, sha512 or sha3_224/256/384/512 of a string or binary column."""
    raw = c.cast("binary")
    if kind == "md5":
        return F.md5(raw)
    if kind == "sha1":
        return F.sha1(raw)
    if kind in ("sha256", "sha384", "sha512"):
        return F.sha2(raw, int(kind[3:]))
    if not kind.startswith("sha3_"):
        raise ValueError(f"unknown digest {kind}")

    @F.pandas_udf("string")
    def sha3(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.new(kind, v).hexdigest())

    return sha3(raw)
