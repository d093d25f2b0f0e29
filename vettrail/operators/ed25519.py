"""Ed25519 signatures as RFC 8032 has them. For parity and fixtures, not a security product: nothing here runs in constant time."""

from __future__ import annotations

import hashlib

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    w, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = v - u, z - w, z + w, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a = _add(a, a)
        n >>= 1
    return out


def _point(raw: bytes) -> Point | None:
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    if x & 1 != sign:
        x = P - x
    return x, y, 1, x * y % P


_BASE = _point((4 * pow(5, -1, P) % P).to_bytes(32, "little"))


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature of the message is the key's."""
    if len(public) != 32 or len(signature) != 64:
        return False
    key, nonce, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or nonce is None or s >= ORDER:
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    left, right = _times(s, _BASE), _add(nonce, _times(h, key))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def _packed(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    return (a[1] * z % P | (a[0] * z % P & 1) << 255).to_bytes(32, "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    secret, prefix = _secret(seed)
    number = lambda *parts: int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER
    r = number(prefix, message)
    nonce = _packed(_times(r, _BASE))
    return nonce + ((r + number(nonce, public_key(seed), message) * secret) % ORDER).to_bytes(32, "little")
