"""Payloads of trace events without secrets, long texts shortened."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words in a key that hide its value, and keys whose text is shortened.
SECRETS = ("api_key", "authorization", "token", "password", "secret")
TEXTS = ("text", "raw_text", "content", "prompt")
PREVIEW = 160


def _clean(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if any(s in k.lower() for s in SECRETS) else _short(v) if k.lower() in TEXTS else _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _short(value) -> str:
    text = " ".join(str(value if value is not None else "").split())
    return text if len(text) <= PREVIEW else text[: PREVIEW - 1] + "..."


def _one(payload: str) -> str:
    try:
        return json.dumps(_clean(json.loads(payload)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return _short(payload)


@F.pandas_udf(StringType())
def redacted(payload: pd.Series) -> pd.Series:
    """A JSON payload with the values of secret keys hidden and long texts cut; what is no JSON is cut as a text."""
    return payload.map(_one, na_action="ignore")
