"""Content identifiers: canonical CBOR of a recipe, hashed and wrapped as a CIDv1 in lower-case base32."""

from __future__ import annotations

import base64
import hashlib
import math
import struct

#: CIDv1, dag-cbor, sha2-256, digest length (fixed values).
PREFIX = bytes((0x01, 0x71, 0x12, 0x20))


def _head(major: int, n: int) -> bytes:
    """Shortest form of a CBOR head."""
    if n < 24:
        return bytes([major << 5 | n])
    for code, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * width:
            return bytes([major << 5 | code]) + n.to_bytes(width, "big")
    raise ValueError("number wider than 64 bits")


def encode(value) -> bytes:
    """Canonical CBOR: one byte string per value; 1 and 1.0 differ, maps are ordered by their encoded keys."""
    match value:
        case None:
            return b"\xf6"
        case bool():
            return b"\xf5" if value else b"\xf4"
        case int():
            return _head(0, value) if value >= 0 else _head(1, -1 - value)
        case float():
            if not math.isfinite(value):
                raise ValueError("NaN and infinities have no canonical form")
            return b"\xfb" + struct.pack(">d", value)
        case str():
            raw = value.encode()
            return _head(3, len(raw)) + raw
        case bytes() | bytearray():
            return _head(2, len(value)) + bytes(value)
        case dict():
            if not all(isinstance(k, str) for k in value):
                raise TypeError("map keys must be text")
            return _head(5, len(value)) + b"".join(k + encode(v) for k, v in sorted((encode(k), v) for k, v in value.items()))
        case list() | tuple():
            return _head(4, len(value)) + b"".join(map(encode, value))
    raise TypeError(f"no canonical form for {type(value).__name__}")


def wrap(payload: bytes) -> str:
    raw = PREFIX + hashlib.sha256(payload).digest()
    return "b" + base64.b32encode(raw).decode().rstrip("=").lower()


def recipe_cid(op: str, params: dict, parents: list[str]) -> str:
    return wrap(encode({"op_name": op, "params": dict(params), "parents": list(parents)}))


def evidence_digest(payload: bytes | str) -> str:
    """Evidence is identified by its plain sha256."""
    return hashlib.sha256(payload.encode() if isinstance(payload, str) else payload).hexdigest()
