"""ABI event signatures: parsing, hashing and encoding, once per signature on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """The 24 constants, from the degree-8 shift register that defines them."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


_CONSTANTS = _round_constants()


def _rotate(x: int, n: int) -> int:
    n %= 64
    return ((x << n) | (x >> (64 - n))) & _MASK if n else x


def _permute(a: list[list[int]]) -> list[list[int]]:
    for constant in _CONSTANTS:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[x - 1] ^ _rotate(c[(x + 1) % 5], 1) for x in range(5)]
        a = [[a[x][y] ^ d[x] for y in range(5)] for x in range(5)]
        x, y, current = 1, 0, a[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            current, a[x][y] = a[x][y], _rotate(current, (t + 1) * (t + 2) // 2)
        a = [[a[x][y] ^ (~a[(x + 1) % 5][y] & a[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


@cache
def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding (not SHA3-256)."""
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    state = [[0] * 5 for _ in range(5)]
    for i in range(0, len(padded), rate):
        for k in range(rate // 8):
            state[k % 5][k // 5] ^= int.from_bytes(padded[i + 8 * k : i + 8 * k + 8], "little")
        state = _permute(state)
    return b"".join(state[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


@dataclass(frozen=True)
class Abi:
    """kind: address, bool, uint, int, fixed (bytesN), bytes, string or array. size: bits, bytes of bytesN, or the
    length of a fixed array (None if it is dynamic); item: the element of an array."""

    kind: str
    size: int | None = None
    item: Abi | None = None

    @property
    def name(self) -> str:
        if self.kind == "array":
            return f"{self.item.name}[{'' if self.size is None else self.size}]"
        return {"fixed": "bytes"}.get(self.kind, self.kind) + (str(self.size) if self.kind in ("uint", "int", "fixed") else "")

    @property
    def dynamic(self) -> bool:
        return self.kind in ("bytes", "string") or self.kind == "array" and (self.size is None or self.item.dynamic)

    @property
    def head_bytes(self) -> int:
        """Bytes that a parameter takes in the head: static arrays lie there in full."""
        return self.size * self.item.head_bytes if self.kind == "array" and not self.dynamic else 32


def parse_type(text: str) -> Abi:
    text = text.strip()
    if m := re.fullmatch(r"(.+)\[(\d*)\]", text):
        return Abi("array", int(m[2]) if m[2] else None, parse_type(m[1]))
    if text in ("address", "bool", "bytes", "string"):
        return Abi(text)
    if m := re.fullmatch(r"(u?int)(\d*)", text):
        bits = int(m[2] or 256)
        if bits % 8 or not 8 <= bits <= 256:
            raise ValueError(f"{text}: the width must be a multiple of 8 up to 256")
        return Abi(m[1], bits)
    if m := re.fullmatch(r"bytes(\d+)", text):
        if not 1 <= int(m[1]) <= 32:
            raise ValueError(f"{text}: bytesN takes 1 to 32")
        return Abi("fixed", int(m[1]))
    raise ValueError(f"unknown ABI type {text!r}")


@dataclass(frozen=True)
class Parameter:
    name: str
    type: Abi
    indexed: bool


@dataclass(frozen=True)
class Signature:
    name: str
    parameters: tuple[Parameter, ...]

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(p.type.name for p in self.parameters)})"

    @property
    def topic(self) -> bytes:
        return keccak256(self.canonical.encode())

    @property
    def selector(self) -> bytes:
        return self.topic[:4]

    def parameter(self, name: str) -> Parameter:
        for p in self.parameters:
            if p.name == name:
                return p
        raise KeyError(f"{self.canonical} has no parameter {name!r}")

    def topic_column(self, name: str) -> str:
        """The topic that holds an indexed parameter: the k-th indexed one is in topic k."""
        indexed = [p.name for p in self.parameters if p.indexed]
        return f"topic{indexed.index(name) + 1}"


def parse_signature(text: str) -> Signature:
    """`Name(type [indexed] [name], ...)`; an unnamed parameter i is called arg{i}. At most three are indexed."""
    m = re.fullmatch(r"\s*(?:event\s+|function\s+)?([A-Za-z_$][\w$]*)\s*\((.*)\)\s*;?\s*", text, re.S)
    if not m:
        raise ValueError(f"not a signature: {text!r}")
    parameters = []
    for i, part in enumerate(p for p in m[2].split(",") if m[2].strip()):
        words = part.split()
        if not words:
            raise ValueError(f"an empty parameter in {text!r}")
        rest = words[1:]
        indexed = bool(rest) and rest[0] == "indexed"
        rest = rest[indexed:]
        if len(rest) > 1:
            raise ValueError(f"can't read the parameter {part.strip()!r}")
        parameters.append(Parameter(rest[0] if rest else f"arg{i}", parse_type(words[0]), indexed))
    if sum(p.indexed for p in parameters) > 3:
        raise ValueError("an event has at most three indexed parameters")
    names = [p.name for p in parameters]
    if len(set(names)) < len(names):
        raise ValueError(f"a parameter name occurs twice in {text!r}")
    return Signature(m[1], tuple(parameters))


def encode_word(kind: Abi, value) -> bytes:
    """A static value as its 32-byte word: integers of either sign to their full width, left-padded addresses,
    right-padded bytesN."""
    if kind.kind in ("uint", "int"):
        n = int(value, 0) if isinstance(value, str) else int(value)
        low, high = (0, 1 << kind.size) if kind.kind == "uint" else (-(1 << kind.size - 1), 1 << kind.size - 1)
        if not low <= n < high:
            raise ValueError(f"{value} is not in the range of {kind.name}")
        return (n % (1 << 256)).to_bytes(32, "big")
    if kind.kind == "bool":
        return int(bool(value)).to_bytes(32, "big")
    raw = bytes.fromhex(value.removeprefix("0x")) if isinstance(value, str) else bytes(value)
    if kind.kind == "address" and len(raw) == 20:
        return raw.rjust(32, b"\0")
    if kind.kind == "fixed" and len(raw) == kind.size:
        return raw.ljust(32, b"\0")
    raise ValueError(f"can't encode {value!r} as {kind.name}")


TRANSFER = parse_signature("Transfer(address indexed from, address indexed to, uint256 value)")
APPROVAL = parse_signature("Approval(address indexed owner, address indexed spender, uint256 value)")
SWAP = parse_signature("Swap(address indexed sender, uint256 amount0In, uint256 amount1In, uint256 amount0Out, uint256 amount1Out, address indexed to)")
