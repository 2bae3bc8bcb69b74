"""Commitments, keyed subject digests and redaction as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "sha256:"


def commitment(columns: dict[str, Column]) -> Column:
    """Digest of the compact JSON object with sorted keys; nulls are kept."""
    body = F.struct(*[columns[name].alias(name) for name in sorted(columns)])
    return F.concat(F.lit(PREFIX), F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256))


def fingerprint(columns: Sequence[str]) -> Column:
    """Digest of a row's columns as a JSON object."""
    return commitment({name: F.col(name) for name in columns})


def hmac_keys(spark: SparkSession, key: bytes) -> DataFrame:
    """One-row frame with the padded keys; joined in, so the key never shows in a plan."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = (bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block))
    return spark.createDataFrame([(bytearray(pads[0]), bytearray(pads[1]))], "ipad binary, opad binary")


def subject_commitment(df: DataFrame, id_col: str, key: bytes, domain: str, name: str = "subject_commitment") -> DataFrame:
    """HMAC-SHA256 of ``domain NUL id``; the raw id column is dropped."""
    keyed = df.crossJoin(F.broadcast(hmac_keys(df.sparkSession, key)))
    message = F.concat(F.encode(F.lit(domain), "utf-8"), F.unhex(F.lit("00")), F.encode(F.col(id_col).cast("string"), "utf-8"))
    inner = F.unhex(F.sha2(F.concat(F.col("ipad"), message), 256))
    digest = F.sha2(F.concat(F.col("opad"), inner), 256)
    return keyed.withColumn(name, digest).drop("ipad", "opad", id_col)


REDACTED = "[REDACTED]"
# Key names whose values never leave the system.
SENSITIVE_KEYS = (
    "access_token", "api_key", "authorization", "client_secret", "cookie", "password",
    "refresh_token", "secret", "set-cookie", "token", "x-api-key",
)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def redacted_text(text: str | None, keys: frozenset[str]) -> str | None:
    """The JSON text with the values of ``keys`` replaced at any depth, all else as it was.

    Keys are compared as decoded names in lower case.  What does not parse gives
    nothing, so no part of a broken text comes through.
    """
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    parts, done, tokens = [], 0, list(_TOKEN.finditer(text))
    i = 0
    while i < len(tokens) - 1:
        is_key = tokens[i][0].startswith('"') and tokens[i + 1][0] == ":"
        i += 1
        if not is_key or json.loads(tokens[i - 1][0]).lower() not in keys:
            continue
        first = last = i + 1
        depth = 0
        while True:
            depth += (tokens[last][0] in "{[") - (tokens[last][0] in "}]")
            if depth == 0:
                break
            last += 1
        parts += [text[done : tokens[first].start()], f'"{REDACTED}"']
        done, i = tokens[last].end(), last + 1
    return "".join(parts) + text[done:]


def redact_json(text: Column, keys: Sequence[str] = SENSITIVE_KEYS) -> Column:
    """Values of sensitive keys, whole objects and arrays included, replaced at any depth."""
    names = frozenset(k.lower() for k in keys)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted_text(t, names))

    return hidden(text)


def redact_url(url: Column, keys: Sequence[str] = SENSITIVE_KEYS) -> Column:
    """Query values of sensitive keys replaced and the fragment dropped; null unless http(s)."""
    names = "|".join(k.replace("-", "\\-") for k in keys)
    clean = F.regexp_replace(url, r"#.*$", "")
    hidden = F.regexp_replace(clean, rf"(?i)([?&](?:{names})=)[^&]*", f"$1{REDACTED}")
    return F.when(url.rlike(r"^https?://[^/?#]+"), hidden)
