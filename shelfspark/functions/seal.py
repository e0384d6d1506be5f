"""Sealed text columns: AES-256-GCM with a named key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import col

IV_BYTES, TAG_BYTES = 12, 16


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret).cast("binary"), 256))


def _encode(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value), "+/", "-_"), F.lit("="))


def _decode(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), ((F.length(text) + 3) / 4).cast("int") * 4, F.lit("="))
    return F.when(text.rlike("^[A-Za-z0-9_-]+$"), F.try_to_binary(padded, F.lit("base64")))


def seal(value, key_id: str, secret: str) -> Column:
    """v2.<key id>.<iv>.<tag>.<ciphertext>, each part in url-safe base64."""
    boxed = F.aes_encrypt(col(value).cast("binary"), _key(secret), F.lit("GCM"))
    # One lambda argument holds the cipher output, so the random iv is drawn once per row.
    return F.transform(F.array(boxed), lambda b: F.concat_ws(
        ".", F.lit("v2"), F.lit(key_id),
        _encode(F.substring(b, 1, IV_BYTES)),
        _encode(F.substr(b, F.length(b) - TAG_BYTES + 1, F.lit(TAG_BYTES))),
        _encode(F.substr(b, F.lit(IV_BYTES + 1), F.length(b) - IV_BYTES - TAG_BYTES)),
    ))[0]


def _decrypt(iv: Column, tag: Column, cipher: Column, secret: str) -> Column:
    plain = F.try_aes_decrypt(F.concat(_decode(iv), _decode(cipher), _decode(tag)), _key(secret), F.lit("GCM"))
    return plain.cast("string")


def unseal(sealed, secrets: dict[str, str], legacy: tuple[str, ...] = ()) -> Column:
    """Plain text, or null when no configured key opens the value."""
    part = F.split(col(sealed), r"\.")
    named = [
        F.when((part[0] == "v2") & (part[1] == key_id), _decrypt(F.get(part, F.lit(2)), F.get(part, F.lit(3)),
                                                                 F.get(part, F.lit(4)), secret))
        for key_id, secret in secrets.items()
    ]
    old = [F.when(part[0] == "v1", _decrypt(F.get(part, F.lit(1)), F.get(part, F.lit(2)), F.get(part, F.lit(3)), s))
           for s in legacy]
    return F.coalesce(*named, *old, F.lit(None).cast("string"))


def reseal(cards: DataFrame, column: str, secrets: dict[str, str], new_key_id: str, legacy=()) -> DataFrame:
    """Key rotation: open with any known key, seal with the new one, keep what cannot be opened."""
    plain = unseal(column, secrets, legacy)
    return (cards.withColumn("_plain", plain)
            .withColumn(column, F.when(F.col("_plain").isNotNull(), seal("_plain", new_key_id, secrets[new_key_id]))
                        .otherwise(F.col(column)))
            .drop("_plain"))
