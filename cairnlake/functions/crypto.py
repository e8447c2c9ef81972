"""HKDF-SHA256 (RFC 5869) and ChaCha20-Poly1305 (RFC 8439).

No cipher library is at hand, so the stream is computed with NumPy, all blocks of a
frame at once, and the authenticator with Python's integers.
"""

from __future__ import annotations

import hashlib
import hmac
import struct

import numpy as np

from cairnlake.errors import AuthenticationFailed

_CONSTANT = np.frombuffer(b"expand 32-byte k", "<u4")  # fixed value of the cipher
def hkdf_sha256(salt: bytes, secret: bytes, info: bytes, length: int) -> bytes:
    key = hmac.new(salt, secret, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _quarter_rounds(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """One quarter round in each of four columns, of all blocks."""
    for turn, other in ((16, 12), (8, 7)):
        a = a + b
        d = _rotate(d ^ a, turn)
        c = c + d
        b = _rotate(b ^ c, other)
    return a, b, c, d


def _blocks(key: bytes, nonce: bytes, first: int, count: int) -> bytes:
    """The key stream of so many blocks."""
    start = np.empty((16, count), np.uint32)
    start[:4] = _CONSTANT[:, None]
    start[4:12] = np.frombuffer(key, "<u4")[:, None]
    start[12] = (first + np.arange(count, dtype=np.uint64)).astype(np.uint32)
    start[13:] = np.frombuffer(nonce, "<u4")[:, None]
    a, b, c, d = start.reshape(4, 4, count)
    turned = [np.roll(np.arange(4), -k) for k in range(4)]
    for _ in range(10):
        a, b, c, d = _quarter_rounds(a, b, c, d)
        a, b, c, d = _quarter_rounds(a, b[turned[1]], c[turned[2]], d[turned[3]])  # diagonals
        b, c, d = b[turned[3]], c[turned[2]], d[turned[1]]
    return (np.concatenate([a, b, c, d]) + start).T.astype("<u4").tobytes()


def _xor(data: bytes, stream: bytes) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8, len(data))).tobytes()


def chacha20(key: bytes, nonce: bytes, data: bytes, first: int = 1) -> bytes:
    return _xor(data, _blocks(key, nonce, first, -(-len(data) // 64))) if data else b""


def poly1305(key: bytes, data: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total, prime = 0, (1 << 130) - 5
    for at in range(0, len(data), 16):
        block = data[at : at + 16]
        total = (total + int.from_bytes(block + b"\1", "little")) * r % prime
    return ((total + int.from_bytes(key[16:], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(one_time: bytes, sealed: bytes, aad: bytes) -> bytes:
    pad = lambda x: x + bytes(-len(x) % 16)
    return poly1305(one_time, pad(aad) + pad(sealed) + struct.pack("<QQ", len(aad), len(sealed)))


def _stream(key: bytes, nonce: bytes, size: int) -> tuple[bytes, bytes]:
    """(the authenticator's key, which is block 0, the key stream of the data behind it)."""
    stream = _blocks(key, nonce, 0, 1 - (-size // 64))
    return stream[:32], stream[64:]


def seal(key: bytes, nonce: bytes, data: bytes, aad: bytes) -> tuple[bytes, bytes]:
    """(sealed bytes, tag)."""
    one_time, stream = _stream(key, nonce, len(data))
    sealed = _xor(data, stream)
    return sealed, _tag(one_time, sealed, aad)


def unseal(key: bytes, nonce: bytes, sealed: bytes, tag: bytes, aad: bytes) -> bytes:
    one_time, stream = _stream(key, nonce, len(sealed))
    if not hmac.compare_digest(_tag(one_time, sealed, aad), tag):
        raise AuthenticationFailed
    return _xor(sealed, stream)


class FrameKey:
    """A secret for one key slot; each record gets its own key and nonce from the pack's salt and the record's context."""

    def __init__(self, secret: bytes, slot: bytes):
        if len(secret) != 32 or len(slot) != 16:
            raise AuthenticationFailed("a secret has 32 bytes, a slot 16")
        self.secret, self.slot = secret, slot

    def accepts(self, slot: bytes) -> bool:
        return hmac.compare_digest(slot, self.slot)

    def _material(self, salt: bytes, slot: bytes, info: bytes) -> tuple[bytes, bytes]:
        if not self.accepts(slot):
            raise AuthenticationFailed("key slot")
        material = hkdf_sha256(salt, self.secret, info, 44)
        return material[:32], material[32:]

    def seal(self, salt: bytes, slot: bytes, info: bytes, aad: bytes, data: bytes) -> tuple[bytes, bytes]:
        return seal(*self._material(salt, slot, info), data, aad)

    def unseal(self, salt: bytes, slot: bytes, info: bytes, aad: bytes, sealed: bytes, tag: bytes) -> bytes:
        return unseal(*self._material(salt, slot, info), sealed, tag, aad)
