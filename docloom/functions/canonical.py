"""One text for equal JSON values, so that equal configurations hash alike."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_text(value: Mapping[str, Any]) -> str:
    """Keys in order at every level, no blanks, letters as they are."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def canonical_json(c: Column | str) -> Column:
    """The same for a column of JSON texts: null where the text is no JSON or has a key twice.

    Decimal numbers lose trailing zeros of their fraction (1.50 is 1.5, and 2.0 is 2); numbers
    with an exponent are doubles and keep a fraction (1e2 is 100.0).
    """
    return F.to_json(F.try_parse_json(c if isinstance(c, Column) else F.col(c)))


def config_hash(c: Column | str) -> Column:
    return F.sha2(canonical_json(c), 256)
