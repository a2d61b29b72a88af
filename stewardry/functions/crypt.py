"""Encryption of stored values: one key per data subject, AES-GCM with a random nonce per value."""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.runtime import free_name

#: Subject of rows that nobody owns.
DEFAULT = "__default__"


def _draw_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(key=[secrets.token_bytes(32) for _ in range(len(batch))])


def new_keys(subjects: DataFrame, subject: str) -> DataFrame:
    """(subject, key): a 256-bit key from the system's secure source per distinct subject and one for rows without. Store it before use, in one place: it is drawn anew each time."""
    all_ = subjects.select(F.coalesce(F.col(subject).cast("string"), F.lit(DEFAULT)).alias("subject")).distinct()
    own = subjects.sparkSession.createDataFrame([(DEFAULT,)], "subject string")
    return all_.unionByName(own).distinct().mapInPandas(_draw_keys, "subject string, key binary")


def _with_key(df: DataFrame, subject: str, keys: DataFrame) -> tuple[DataFrame, str]:
    key, at = free_name(df, "row_key"), free_name(df, "row_subject")
    named = keys.select(F.col("subject").alias(at), F.col("key").alias(key))
    return df.join(named, F.coalesce(F.col(subject).cast("string"), F.lit(DEFAULT)) == F.col(at), "left").drop(at), key


def encrypt(df: DataFrame, subject: str, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Replaces each column by its ciphertext under the key of the row's subject; nulls stay null."""
    keyed, key = _with_key(df, subject, keys)
    return keyed.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), key, F.lit("GCM")) for c in columns}).select(*df.columns)


def decrypt(df: DataFrame, subject: str, columns: dict[str, str], keys: DataFrame) -> DataFrame:
    """The inverse; ``columns`` gives each column's type. A value whose key is gone cannot be read and becomes null."""
    keyed, key = _with_key(df, subject, keys)
    plain = {c: F.when(F.col(key).isNotNull(), F.aes_decrypt(c, key, F.lit("GCM")).cast("string").cast(kind)) for c, kind in columns.items()}
    return keyed.withColumns(plain).select(*df.columns)
