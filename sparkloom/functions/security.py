"""Keyed hashes, tokens, encryption and masking of secrets."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MASK = "****"
#: Keys whose values are secrets.
SENSITIVE = ("password", "passwd", "pwd", "pass", "secret", "token", "key", "api_key", "auth", "credential", "access_token", "private_key")
NONCE, SALT = 12, 16
ROUNDS = 200_000


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hexadecimal HMAC-SHA256, in the JVM."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def base62(data: bytes) -> str:
    """Big-endian digits without leading zeros; 0 for no data."""
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 62)
        out.append(DIGITS[r])
    return "".join(reversed(out)) or "0"


def token(key: bytes, label: str, payload: str, length: int = 22) -> str:
    return base62(hmac.digest(key, f"{label}||{payload}".encode(), "sha256"))[:length]


def tokens(key: bytes, label: Column, payload: Column, length: int = 22) -> Column:
    """Keyed token of label and payload; null payloads count as empty. One Arrow pass makes digest and digits."""

    @F.arrow_udf("string")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, texts in batches:
            yield pa.array([token(key, a, b or "", length) for a, b in zip(names.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return made(label, payload)


def encrypt(plain: Column, key: bytes) -> Column:
    """AES-GCM with a random nonce in front, as URL-safe base64."""
    return F.translate(F.base64(F.aes_encrypt(plain.cast("binary"), F.lit(checked_key(key)), F.lit("GCM"))), "+/", "-_")


def decrypt(sealed: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(F.translate(sealed, "-_", "+/")), F.lit(checked_key(key)), F.lit("GCM")).cast("string")


def checked_key(key: bytes) -> bytes:
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    return key


def key_from_password(password: str, salt: bytes | None = None) -> tuple[bytes, bytes]:
    """Key and salt, by PBKDF2-SHA256."""
    salt = os.urandom(SALT) if salt is None else salt
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 32), salt


def encrypt_with_password(plain: Column, password: str, salt: bytes | None = None) -> Column:
    """The salt and what encrypt() gives, one salt for the column, as URL-safe base64."""
    key, salt = key_from_password(password, salt)
    sealed = F.concat(F.lit(salt), F.aes_encrypt(plain.cast("binary"), F.lit(key), F.lit("GCM")))
    return F.translate(F.base64(sealed), "+/", "-_")


def decrypt_with_password(sealed: Column, password: str, salt: bytes) -> Column:
    """The inverse for rows with this salt; others give null. salt_of() tells a row's salt."""
    key, _ = key_from_password(password, salt)
    data = F.unbase64(F.translate(sealed, "-_", "+/"))
    body = F.substring(data, SALT + 1, 1 << 30)
    return F.when(salt_of(sealed) == F.lit(base64.b64encode(salt).decode()), F.aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string"))


def salt_of(sealed: Column) -> Column:
    return F.base64(F.substring(F.unbase64(F.translate(sealed, "-_", "+/")), 1, SALT))


def content_hash(content: Column, path: Column | None = None, algorithm: str = "sha256") -> Column:
    """Hexadecimal hash of a file's content, salted with its path if given."""
    data = content.cast("binary")
    if path is not None:
        data = F.concat(F.lit("PATH::").cast("binary"), path.cast("binary"), data)
    kinds = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}
    if algorithm in kinds:
        return kinds[algorithm](data)

    @F.arrow_udf("string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([None if d is None else hashlib.new(algorithm, d).hexdigest() for d in x.to_pylist()], pa.string())

    return digest(data)


def masked_url(raw: Column) -> Column:
    """The URL with its password masked; null where there is none."""
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/@]+):([^@]*)@"
    return F.when(raw.rlike(pattern), F.regexp_replace(raw, pattern, f"$1:{MASK}@"))


def masked_pairs(raw: Column, sensitive: Sequence[str] = SENSITIVE) -> Column:
    """k=v pairs, parted by ; if there is one and else by &, with secret values masked; null if none is."""
    key = lambda p: F.trim(F.substring_index(p, "=", 1))
    secret = lambda p: p.contains("=") & F.lower(key(p)).isin(list(sensitive))
    parts = F.when(raw.contains(";"), F.split(raw, ";")).otherwise(F.split(raw, "&"))
    out = F.transform(parts, lambda p: F.when(secret(p), F.concat(key(p), F.lit(f"={MASK}"))).otherwise(p))
    return F.when(F.exists(parts, secret), F.when(raw.contains(";"), F.array_join(out, ";")).otherwise(F.array_join(out, "&")))


#: Patterns of secrets in connection strings, each with what is kept.
GENERIC = (
    (r"(?i)(password=)[^;&\s]+", f"$1{MASK}"),
    (r"(?i)(pwd=)[^;&\s]+", f"$1{MASK}"),
    (r"(?i)(pass=)[^;&\s]+", f"$1{MASK}"),
    (r"(?i)(:)([^@:/]+)(@)", f"$1{MASK}$3"),
)
#: Patterns of secrets that are assigned in free text.
ASSIGNED = (
    (r"(?i)\b(password|passwd|pwd)(\s*[:=]\s*)([^\s;&,]+)", f"$1$2{MASK}"),
    (r"(?i)\b(token|secret|api_?key|access_?key)(\s*[:=]\s*)(\"?)([^\s\";&,]+)(\"?)", f"$1$2$3{MASK}$5"),
    (r"(?i)\b(bearer)(\s+)([A-Za-z0-9._~+/-]+=*)", f"$1$2{MASK}"),
)


def masked_text(raw: Column, patterns: Sequence[tuple[str, str]] = GENERIC) -> Column:
    """Text with secrets masked; null if there is none."""
    out = raw
    for pattern, kept in patterns:
        out = F.regexp_replace(out, pattern, kept)
    return F.when(out != raw, out)


def masked(raw: Column) -> Column:
    """What the first rule with a hit gives, of URL, pairs and text; else the value. Empty stays empty."""
    return F.when(raw == "", raw).otherwise(F.coalesce(masked_url(raw), masked_pairs(raw), masked_text(raw), raw))
