"""Hash arithmetic for bloom positions and the checkpoint contract signature."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import col

# Default size and error rate of a filter.
EXPECTED_ITEMS = 10_000_000
ERROR_RATE = 0.001


def bloom_shape(expected: int = EXPECTED_ITEMS, rate: float = ERROR_RATE) -> tuple[int, int]:
    """(bits, hashes) for a number of items and an error rate, both rounded down."""
    if expected < 1 or not 0 < rate < 1:
        raise ValueError("need expected >= 1 and 0 < rate < 1")
    bits = -expected * math.log(rate) / math.log(2) ** 2
    return int(bits), int(bits / expected * math.log(2))


def hex_mod(digest: Column, words: int, modulus: Column | int) -> Column:
    """A hex digest of 32-bit words as a big number modulo ``modulus``.

    In steps of 16 bits, so that a bigint holds every step for any modulus below 2**47.
    """
    modulus = F.lit(modulus) if isinstance(modulus, int) else modulus
    rest = F.lit(0).cast("bigint")
    for w in range(2 * words):
        word = F.conv(F.substring(digest, w * 4 + 1, 4), 16, 10).cast("bigint")
        rest = (rest * F.lit(65536).cast("bigint") + word) % modulus
    return rest


def bloom_positions(item: Column | str, bits: int, hashes: int) -> Column:
    """The ``hashes`` bit positions of an item, by double hashing with MD5 and SHA-1."""
    item = col(item)
    first = hex_mod(F.md5(item), 4, bits)
    second = hex_mod(F.sha1(item), 5, bits)
    pair = F.array(F.struct(first.alias("a"), second.alias("b")))
    # Through one array element, so that both digests are computed once per row.
    return F.flatten(
        F.transform(
            pair,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(hashes - 1)),
                lambda i: (h["a"] + i.cast("bigint") * h["b"]) % F.lit(bits).cast("bigint"),
            ),
        )
    )


# The parts of a job that decide whether old pages may be reused.
CONTRACT_KEYS = (
    "render", "first_url", "pagination", "item_selector", "fields", "api",
    "headers", "user_agent", "storage_state", "page_wait",
)


def contract_signature(config: Mapping[str, Any], scope: str | None = None) -> str:
    """16 hex digits naming a source and extraction contract (driver side, one per job)."""
    import hashlib

    defaults = {"render": "direct", "pagination": {}, "fields": {}, "api": {}, "headers": {}}
    contract = {key: config.get(key, defaults.get(key)) for key in CONTRACT_KEYS}
    contract |= {"version": 2, "checkpoint_scope": scope}
    text = json.dumps(
        contract, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str
    )
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def signature_column(canonical_json: Column | str) -> Column:
    """The same signature for a column that already holds canonical JSON."""
    return F.substring(F.sha2(col(canonical_json), 256), 1, 16)


def row_fingerprint(columns: list[str]) -> Column:
    """All values of a row as one digest; a missing value counts as ''.

    Each value is written with its length before it, so no two rows read the same.
    """
    parts: list[Column] = []
    for c in sorted(columns):
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts += [F.length(value).cast("string"), F.lit(":"), value]
    return F.sha2(F.concat(*parts), 256)


def open_row_fingerprint(columns: list[str]) -> Column:
    """A digest of a row that stays the same when its table gains columns: values that are missing or '' say nothing."""
    parts: list[Column] = [F.lit("")]
    for c in sorted(columns):
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        named = F.concat(F.lit(f"{len(c)}:{c}="), F.length(value).cast("string"), F.lit(":"), value)
        parts.append(F.when(value == "", "").otherwise(named))
    return F.sha2(F.concat(*parts), 256)
