"""Reading the claims of a bearer token. Signatures are not checked here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_payload(token: Column) -> Column:
    """JSON text of the middle part of a token, or null if it cannot be read."""
    part = F.get(F.split(token, r"\."), F.lit(1))
    plain = F.translate(part, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(part.rlike(r"^[0-9A-Za-z_-]+$") & (F.length(part) % 4 != 1),
                  F.unbase64(padded).cast("string"))


def claim(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")
