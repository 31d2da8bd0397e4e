"""Static range asymmetric numeral system over numpy lanes: self-contained blocks with checkpoints and checksums.

Token t of a block belongs to lane t mod LANES; all lanes share one word
stream.  A state lies in [2^31, 2^63); 32-bit words leave it when a symbol
would overflow it and come back in the same order on decoding.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, SCALE, LOW = 1024, 20, np.uint64(1 << 31)
CHECKPOINT_STEPS = 128
MAGIC = b"RTB1"
_HEAD = struct.Struct("<4sIIIII")
_MASK = np.uint64((1 << SCALE) - 1)
_S, _W = np.uint64(SCALE), np.uint64(32)


class Table:
    """Frequencies scaled to sum to 2^SCALE, at least 1 for every symbol that occurs."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        total = 1 << SCALE
        if len(symbols) > total // 2:
            raise ValueError("too many symbols for the scale")
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64) if len(symbols) else np.zeros(0, np.int64)
        while len(freq) and (off := total - int(freq.sum())):
            if off > 0:
                freq[np.argmax(freq)] += off
            else:  # take from the largest, keeping each above 0
                big = np.argsort(-freq, kind="stable")[:max(1, min(len(freq), -off))]
                take = np.minimum(freq[big] - 1, np.maximum(1, -off // len(big)))
                take[np.cumsum(take) > -off] = 0
                freq[big] -= take
        self.symbols, self.freq = symbols, freq
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.int64) if len(freq) else freq
        size = int(symbols[-1]) + 1 if len(symbols) else 1
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[symbols], self.c[symbols] = freq, start
        self.of = np.repeat(symbols, freq).astype(np.uint16 if size <= 1 << 16 else np.uint32)


def encode_block(ids: np.ndarray, table: Table, doc_ids: np.ndarray, present: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block: header, documents, final states, checkpoints, words, and a checksum of all that and of the ids."""
    n, steps = len(ids), -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    f, c = table.f[ids], table.c[ids]
    most = f << np.uint64(63 - SCALE)
    out: list[np.ndarray] = []
    kept: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        if t % CHECKPOINT_STEPS == CHECKPOINT_STEPS - 1 and t != steps - 1:
            kept.append((len(out), x.copy()))  # the state with which decoding goes on after step t
        s, ft = x[:b - a], f[a:b]
        full = s >= most[a:b]
        out.append(s[full].astype(np.uint32))
        s = np.where(full, s >> _W, s)
        q = s // ft
        x[:b - a] = (q << _S) + (s - q * ft) + c[a:b]
    sizes = np.array([len(w) for w in out], np.int64)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    marks = b"".join(struct.pack("<Q", int(sizes[at:].sum())) + state.tobytes() for at, state in kept[::-1])
    body = b"".join((doc_ids.astype("<i8").tobytes(), present.astype("u1").tobytes(), lengths.astype("<u4").tobytes(),
                     x.tobytes(), marks, words.astype("<u4").tobytes()))
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = _HEAD.pack(MAGIC, len(doc_ids), n, len(words), len(kept), ids_crc)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


class Block:
    """A parsed block; checksums are verified on parsing and on decoding it whole."""

    def __init__(self, raw: bytes):
        if len(raw) < _HEAD.size + 4 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("block checksum does not match")
        magic, docs, self.n, words, marks, self.ids_crc = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.doc_ids, self.present, self.lengths = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs)
        self.marks = [(0, 0, take("<u8", LANES))]
        for k in range(marks):
            word = int(take("<u8", 1)[0])
            self.marks.append(((k + 1) * CHECKPOINT_STEPS, word, take("<u8", LANES)))
        self.words = take("<u4", words)

    def decode(self, table: Table, mark: int = 0, steps: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``mark`` on (0: the block's start), for ``steps`` steps of LANES tokens or to the end."""
        first, word, state = self.marks[mark]
        x = state.astype(np.uint64)
        last = -(-self.n // LANES) if steps is None else min(-(-self.n // LANES), first + steps)
        out = np.empty(max(0, min(self.n, last * LANES) - first * LANES), np.uint32)
        for t in range(first, last):
            a, b = t * LANES, min(self.n, (t + 1) * LANES)
            s = x[:b - a]
            slot = s & _MASK
            symbol = table.of[slot]
            s = table.f[symbol] * (s >> _S) + slot - table.c[symbol]
            need = s < LOW
            k = int(np.count_nonzero(need))
            if k:
                s[need] = (s[need] << _W) | self.words[word:word + k]
                word += k
            x[:b - a] = s
            out[a - first * LANES:b - first * LANES] = symbol
        if mark == 0 and steps is None and zlib.crc32(out.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("decoded ids do not match their checksum")
        return out
