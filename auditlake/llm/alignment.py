"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut the same bytes; where both end a token, a group ends.  A
text's tokens are cut into chunks by the byte at which they end.  A chunk
becomes a fragment: an open prefix up to the first common end, closed groups,
and an open suffix from the last common end on.  Fragments of neighbouring
chunks compose: suffix and prefix between them make one more group, or stay
open where no common end has been seen.  As composing is associative, the
chunks of a very long text are dealt to many tasks and composed in a tree.

Links are counted over the corpus in two steps: a packed row of many texts
holds each of its distinct id pairs once, only these rows meet the corpus-wide
counts, and the counts go back to the packed row.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, materialise, python_ready

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a text in a chunk, chunks that one task composes at a level of the tree, and characters of texts in a packed row.
CHUNK, FAN_IN, PACKED_CHARS = 1 << 16, 16, 6_000_000
#: Where a text may be cut so that both tokenizers treat the parts like the whole, see :class:`Pair`.
_CUT = re.compile("(?<! ) (?=[!-~¡-ᙹᚁ-᠍])|(?<=[!-~¡-ᙹᚁ-᠍])\n(?=[!-~¡-ᙹᚁ-᠍])")
_PLAIN = re.compile("[ \n][!-~¡-ᙹᚁ-᠍]++")
_SAFE = re.compile("[!-~¡-ᙹᚁ-᠍]++(?:[ \n][!-~¡-ᙹᚁ-᠍]++)*+")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Token ids and lengths in bytes of texts by both tokenizers, the same as encoding each whole text.

    A text is cut before a single blank, and before a single line break
    between two other characters, where neither tokenizer joins what stands on
    both sides: the byte-level one splits there before merging, and no piece
    of the other holds a blank behind another character, nor a line break
    (checked when the file is read).  Distinct parts are encoded once.
    """

    def __init__(self, byte_level: str, pieces: str, remember: int = 600_000):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in n.lstrip("▁") or "\n" in n for n in names):
            raise ValueError("a piece joins words or lines; texts cannot be cut at blanks for this model")
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in name)
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank, self.line_break = self.b.piece_to_id("▁"), vocabulary["Ċ"]
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        #: number of each known part, and by number: whether both tokenizers keep it, and where its ids begin and end (per tokenizer)
        self.known: dict[str, int] = {}
        self.sound = np.empty(0, bool)
        self.ids = [np.empty(0, np.uint32), np.empty(0, np.uint32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _encode_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each part) by the byte-level tokenizer; plain parts many at a time, as lines."""
        plain = np.fromiter((_PLAIN.fullmatch(p) is not None for p in parts), bool, len(parts))
        lines = [p.removeprefix("\n") for p, yes in zip(parts, plain.tolist()) if yes]
        texts = ["\n".join(lines[at:at + 1024]) for at in range(0, len(lines), 1024)]
        found = [np.array([*e.ids, self.line_break], np.uint32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, np.uint32), *found])
        breaks = np.flatnonzero(flat == self.line_break)
        begins = np.append(0, breaks[:-1] + 1) if len(breaks) else breaks
        # a part with a line break before it has one token more, the break itself
        own = [e.ids for e in self.a.encode_batch_fast([p for p, yes in zip(parts, plain.tolist()) if not yes], add_special_tokens=False)]
        size = np.zeros(len(parts), np.int64)
        size[plain], size[~plain] = breaks - begins, [len(x) for x in own]
        broken = np.fromiter((p[0] == "\n" for p in parts), bool, len(parts)) & plain
        size += broken
        out = np.empty(int(size.sum()), np.uint32)
        ends = np.cumsum(size)
        out[(ends - size)[broken]] = self.line_break
        is_plain = np.repeat(plain, size)
        is_plain_word = is_plain.copy()
        is_plain_word[(ends - size)[broken]] = False
        out[is_plain_word] = flat[flat != self.line_break]
        out[~is_plain] = np.fromiter(itertools.chain.from_iterable(own), np.uint32)
        return out, size

    def _encode_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the other tokenizer, which puts a blank before what it encodes: it stands for the part's own."""
        ids = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        for i, p in enumerate(parts):
            if p[0] != " ":  # taken away before a line break
                ids[i] = ids[i][1:] if ids[i][:1] == [self.blank] else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _learn(self, parts: list[str]) -> None:
        """Number new parts and remember both encodings of each, and whether both keep its bytes."""
        raw = [p.encode() for p in parts]
        whole, length = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        sound = np.ones(len(parts), bool)
        for k, (encode, names, sizes) in enumerate(((self._encode_a, self.bytes_a, self.size_a), (self._encode_b, self.bytes_b, self.size_b))):
            ids, size = encode(parts)
            ends = np.cumsum(size)
            same = np.append(0, np.cumsum(sizes[ids]))
            kept = (same[ends] - same[ends - size]) == length
            if not kept.all() or b"".join([names[i] for i in ids.tolist()]) != whole:
                for i in range(len(parts)):
                    kept[i] = b"".join([names[x] for x in ids[ends[i] - size[i]:ends[i]].tolist()]) == raw[i]
            sound &= kept
            self.ends[k] = np.concatenate([self.ends[k], len(self.ids[k]) + ends])
            self.ids[k] = np.concatenate([self.ids[k], ids])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.sound = np.concatenate([self.sound, sound])

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts; new ones are encoded."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > self.remember:
            self._forget()
            new = parts
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(ids, ids) of a blank and each text; None where the bytes of either differ from it, or the text is empty."""
        # parts stand apart by zero characters; a text that holds one itself is a single part
        cut = ["" if not t else self._cut(t) if "\x00" not in t else "" for t in texts]
        with_zero = {i: " " + t for i, t in enumerate(texts) if t and "\x00" in t}
        coded = pc.split_pattern(pa.array(["\x00".join(c for c in cut if c)], pa.large_string()), "\x00").flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if names == [""]:
            names, code = [], code[:0]
        number = self._numbers(names + list(dict.fromkeys(with_zero.values())))
        code = number[code]
        sound = self.sound[code]
        sides = [_gather(self.ids[k], self.ends[k], code) for k in (0, 1)]
        out: list = []
        at = 0
        for i, c in enumerate(cut):
            if i in with_zero:
                n = self.known[with_zero[i]]
                out.append(tuple(self.ids[k][self.ends[k][n]:self.ends[k][n + 1]] for k in (0, 1)) if self.sound[n] else None)
                continue
            end = at + (c.count("\x00") + 1 if c else 0)
            out.append(tuple(ids[ends[at]:ends[end]] for ids, ends in sides) if c and sound[at:end].all() else None)
            at = end
        return out

    @staticmethod
    def _cut(text: str) -> str:
        """The parts of a blank and the text, with zero characters between them."""
        if _SAFE.fullmatch(text):  # single blanks and breaks only
            return (" " + text.replace(" ", "\x00 ").replace("\n", "\x00\n"))
        return _CUT.sub("\x00\\g<0>", " " + text).removeprefix("\x00")


def _gather(ids: np.ndarray, edges: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts ``code`` one after another, and where each begins (one more at the end)."""
    start, length = edges[code], edges[code + 1] - edges[code]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(start - ends + length, length) + np.arange(total)], np.concatenate([[0], ends])


@functools.lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    """One encoder per Python worker and pair of files."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Pair(byte_level, pieces)


@dataclass
class Tokens:
    """Neighbouring tokens of both tokenizers over one stretch of bytes: ids, and ends in bytes."""
    a: np.ndarray
    end_a: np.ndarray
    b: np.ndarray
    end_b: np.ndarray

    def part(self, low: int, high: int) -> Tokens:
        """The tokens that end behind byte ``low`` and not behind ``high``."""
        i, j = np.searchsorted(self.end_a, [low, high], "right")
        k, m = np.searchsorted(self.end_b, [low, high], "right")
        return Tokens(self.a[i:j], self.end_a[i:j], self.b[k:m], self.end_b[k:m])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.fields(), other.fields())))

    def fields(self) -> tuple[np.ndarray, ...]:
        return self.a, self.end_a, self.b, self.end_b


NO_TOKENS = Tokens(*(np.empty(0, t) for t in (np.uint32, np.int64, np.uint32, np.int64)))


@dataclass
class Fragment:
    """Tokens before the first common end, and those after the last; ``cut`` is where the first common end lies, -1 if nowhere.

    With no common end all tokens are in ``prefix``.  The groups between, once
    closed, are results and no longer part of the fragment.
    """
    cut: int
    prefix: Tokens
    suffix: Tokens

    def __add__(self, other: Fragment) -> tuple[Fragment, Tokens | None]:
        """The fragment of both, and the group that closes between them, if one does."""
        if self.cut < 0:
            return Fragment(other.cut, self.prefix + other.prefix, other.suffix), None
        if other.cut < 0:
            return Fragment(self.cut, self.prefix, self.suffix + other.prefix), None
        return Fragment(self.cut, self.prefix, other.suffix), self.suffix + other.prefix


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens]:
    """The fragment of a chunk, and the tokens of its closed groups."""
    common = np.intersect1d(tokens.end_a, tokens.end_b, assume_unique=True)
    if not len(common):
        return Fragment(-1, tokens, NO_TOKENS), NO_TOKENS
    low, high, most = int(common[0]), int(common[-1]), np.iinfo(np.int64).max
    return Fragment(low, tokens.part(-1, low), tokens.part(high, most)), tokens.part(low, high)


def _ends_with(ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ends`` are among the sorted ``other``."""
    return other[np.minimum(np.searchsorted(other, ends), len(other) - 1)] == ends


def links(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids) of all pairs of tokens whose bytes overlap.

    ``tokens`` are whole groups.  Between two neighbouring ends of either kind
    exactly one token of each kind lies, and every overlapping pair has one
    such stretch.
    """
    both = np.concatenate([tokens.end_a, tokens.end_b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    last = np.append(both[1:] != both[:-1], True)
    # tokens that have ended before each end: those among the first of the two kinds, and the others
    is_a = order < len(tokens.end_a)
    done_a, done_b = np.cumsum(is_a)[last], np.cumsum(~is_a)[last]
    return tokens.a[np.append(0, done_a[:-1])], tokens.b[np.append(0, done_b[:-1])]


@functools.lru_cache(maxsize=1)
def _written() -> list[str]:
    """At 4 * id + 2 for B tokens + 1 for the last one of a group: the id and the mark behind it, for ids below 2 ** 16."""
    return [f"{i}{mark}" for i in range(1 << 16) for mark in ",|,;"]


def described(tokens: Tokens) -> tuple[int, str]:
    """(number of groups, their text ``a1,a2|b1;...``) of whole groups; the text ends with ``;``."""
    is_end_a, is_end_b = _ends_with(tokens.end_a, tokens.end_b), _ends_with(tokens.end_b, tokens.end_a)
    group_a, group_b = np.cumsum(is_end_a) - is_end_a, np.cumsum(is_end_b) - is_end_b
    groups = int(is_end_a.sum())
    until_a, until_b = np.flatnonzero(is_end_a) + 1, np.flatnonzero(is_end_b) + 1
    before_b = np.append(0, until_b)
    out = np.empty(len(tokens.a) + len(tokens.b), np.int64)
    # a group's A tokens stand behind the B tokens of the groups before, its B tokens behind the A tokens up to and with its own
    out[np.arange(len(tokens.a)) + before_b[group_a]] = tokens.a.astype(np.int64) * 4 + is_end_a
    out[np.arange(len(tokens.b)) + until_a[group_b]] = tokens.b.astype(np.int64) * 4 + 2 + is_end_b
    written = _written()
    if len(out) and out.max() >= len(written):
        return groups, "".join([f"{x >> 2}{',|,;'[x & 3]}" for x in out.tolist()])
    return groups, "".join(map(written.__getitem__, out.tolist()))


def _packed_pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, bytes]:
    """Links of several texts or pieces: distinct pairs, and per row the numbers of its pairs with how often each comes."""
    size = np.array([len(a) for a, _ in rows], np.int64)
    both = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.uint32) for k in (0, 1)]
    code, names = pd.factorize(both[0].astype(np.int64) << 32 | both[1])
    counts = []
    for row, (end, n) in enumerate(zip(np.cumsum(size).tolist(), size.tolist())):
        own = np.sort(code[end - n:end])
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts.append((row, own[first], np.diff(first, append=n)))
    number = np.concatenate([c for _, c, _ in counts]) if counts else np.empty(0, np.int64)
    times = np.concatenate([t for _, _, t in counts]) if counts else np.empty(0, np.int64)
    return {"pa": (names >> 32).astype("<u4").tobytes(), "pb": (names & 0xFFFFFFFF).astype("<u4").tobytes(),
            "held": np.bincount(number, minlength=len(names)).astype("<u4").tobytes(),
            "sizes": np.array([len(c) for _, c, _ in counts], "<u4").tobytes(),
            "numbers": number.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes()}


#: A row per text or closed piece of one: its row number, doc_id, place in the text, counts, digest (whole texts) or text of groups (pieces).
_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("text", pa.string())])
_PACK_SQL = ("pack long, whole boolean, pieces array<struct<row: long, doc_id: long, place: long, n_a: long, n_b: long, n_groups: long, n_links: long, "
             "text: string>>, pa binary, pb binary, held binary, sizes binary, numbers binary, times binary")
_CHUNK_SQL = "row long, doc_id long, chunk long, a binary, end_a binary, b binary, end_b binary"
_CHUNK_TYPES = [pa.int64()] * 3 + [pa.binary()] * 4


def _pack(number: int, whole: bool, pieces: list[tuple], rows: list) -> dict[str, pa.Array]:
    columns = {"pack": pa.array([number], pa.int64()), "whole": pa.array([whole])}
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), _PIECE)], names=_PIECE.names)
    columns["pieces"] = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), structs)
    return columns | {k: pa.array([v], pa.binary()) for k, v in _packed_pairs(rows).items()}


def _chunk_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK_TYPES)]


def _blobs(t: Tokens) -> tuple[bytes, ...]:
    return tuple(x.astype(f"<{k}").tobytes() for x, k in zip(t.fields(), ("u4", "i8", "u4", "i8")))


def _tokens(blobs) -> Tokens:
    return Tokens(*(np.frombuffer(x, f"<{k}") for x, k in zip(blobs, ("u4", "i8", "u4", "i8"))))


_ENCODED_SQL = f"{_PACK_SQL}, " + ", ".join(f"c_{f}" for f in _CHUNK_SQL.split(", "))


def _encoded(docs: DataFrame, byte_level: str, pieces: str, chunk: int) -> DataFrame:
    """Packed rows of the texts of one chunk at most, and a row per chunk of the others (columns c_)."""
    pack_names = [f.split(" ")[0] for f in ("pack", "whole", "pieces", "pa", "pb", "held", "sizes", "numbers", "times")]
    chunk_names = [f"c_{f.split()[0]}" for f in _CHUNK_SQL.split(", ")]

    def run(batches):
        enc = pair(byte_level, pieces)
        pack_types: dict[str, pa.DataType] = {}

        def emit(packed: dict | None, chunks: list[tuple]):
            n = 1 if packed else len(chunks)
            packed = packed or {}
            columns = {k: packed.get(k, pa.nulls(n, pack_types[k])) for k in pack_names}
            own = _chunk_columns(chunks) if chunks else [pa.nulls(n, t) for t in _CHUNK_TYPES]
            return pa.RecordBatch.from_arrays([*columns.values(), *own], [*pack_names, *chunk_names])

        pack_types.update({k: v.type for k, v in _pack(0, True, [(0, None, 0, 0, 0, 0, 0, "")], []).items()})

        def some(rows, ids, texts):
            done, pairs, chunks = [], [], []
            for row, doc, both in zip(rows, ids, enc.encode(texts)):
                if both is None:
                    done.append((row, doc, 0, 0, 0, 0, 0, ""))
                    pairs.append((np.empty(0, np.uint32),) * 2)
                    continue
                t = Tokens(both[0], np.cumsum(enc.size_a[both[0]]), both[1], np.cumsum(enc.size_b[both[1]]))
                if t.end_a[-1] <= chunk:
                    # one chunk: its prefix begins where the text begins, its last end is common, so all of it is closed
                    linked = links(t)
                    groups, text = described(t)
                    done.append((row, doc, 0, len(t.a), len(t.b), groups, len(linked[0]), hashlib.sha256(text[:-1].encode()).hexdigest()))
                    pairs.append(linked)
                    continue
                for number in range(-(-int(t.end_a[-1]) // chunk)):
                    chunks.append((row, doc, number, *_blobs(t.part(number * chunk, (number + 1) * chunk))))
                    if len(chunks) >= 32:
                        yield emit(None, chunks)
                        chunks = []
            if chunks:
                yield emit(None, chunks)
            if done:
                yield emit(_pack(done[0][0], True, done, pairs), [])

        held, size = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                held.append(r)
                size += len(r[2] or "")
                if size >= PACKED_CHARS or len(held) >= 20_000:
                    yield from some(*zip(*held))
                    held, size = [], 0
        if held:
            yield from some(*zip(*held))

    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, _ENCODED_SQL)


_FRAGMENT_SQL = ("row long, doc_id long, chunk long, cut long, pa binary, pea binary, pb binary, peb binary, sa binary, sea binary, sb binary, seb binary, "
                 "ga binary, gea binary, gb binary, geb binary, place long")
_FRAGMENT_TYPES = [pa.int64()] * 4 + [pa.binary()] * 12 + [pa.int64()]


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of fragments, and of closed tokens (columns g; cut is null)."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FRAGMENT_TYPES)], [f.split()[0] for f in _FRAGMENT_SQL.split(", ")])


def _fragments(chunks: DataFrame) -> DataFrame:
    """Fragment and closed groups of every chunk; chunks of one text are dealt to all tasks."""
    def run(batches):
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                found, closed = fragment(_tokens(r[3:]))
                out = [(*r[:3], found.cut, *_blobs(found.prefix), *_blobs(found.suffix), None, None, None, None, None)]
                if len(closed.a):
                    out.append((*r[:3], *[None] * 9, *_blobs(closed), found.cut))
                yield _fragment_batch(out)

    return chunks.repartition("row", "chunk").mapInArrow(run, _FRAGMENT_SQL)


def _composed(fragments: DataFrame) -> DataFrame:
    """One level of the tree: up to FAN_IN neighbouring fragments become one, and the groups closed between them.

    ``place`` of a closed group is a byte at which it begins or a later one
    before the next closed tokens.
    """
    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (row, doc, number), group in itertools.groupby(rows, lambda r: (r[0], r[1], r[2] // FAN_IN)):
            total, out = None, []
            for r in group:
                own = Fragment(r[3], _tokens(r[4:8]), _tokens(r[8:12]))
                if total is None:
                    total = own
                    continue
                total, closed = total + own
                if closed is not None:
                    out.append((row, doc, number, *[None] * 9, *_blobs(closed), own.cut - 1))
            out.append((row, doc, number, total.cut, *_blobs(total.prefix), *_blobs(total.suffix), None, None, None, None, None))
            yield _fragment_batch(out)

    parent = F.floor(F.col("chunk") / FAN_IN)
    placed = fragments.repartition("row", parent).sortWithinPartitions("row", "chunk")
    return placed.mapInArrow(run, _FRAGMENT_SQL)


def _closed_packs(closed: DataFrame, chunk: int) -> DataFrame:
    """Packed rows of the closed tokens of long texts; each piece keeps the text of its groups."""
    names = ["pack", "whole", "pieces", "pa", "pb", "held", "sizes", "numbers", "times"]

    def run(batches):
        def pack(held):
            pairs, pieces = [], []
            for number, row, doc, place, *blobs in held:
                t = _tokens(blobs)
                linked = links(t)
                groups, text = described(t)
                pairs.append(linked)
                pieces.append((row, doc, place, len(t.a), len(t.b), groups, len(linked[0]), text))
            columns = _pack(-1 - held[0][0], False, pieces, pairs)
            return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

        held, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                held.append(r)
                size += len(r[5])
                if size >= 8 * PACKED_CHARS // 4 or len(held) >= 20_000:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return closed.select(F.monotonically_increasing_id().alias("number"), "row", "doc_id", "place", "ga", "gea", "gb", "geb").mapInArrow(run, _PACK_SQL)


def _long_texts(chunks: DataFrame, chunk: int) -> DataFrame:
    """Packed rows of all groups of the texts that were cut into chunks."""
    level = materialise(_fragments(chunks), "fragments")
    closed = level.where(F.col("cut").isNull())
    open_ = level.where(F.col("cut").isNotNull())
    most = open_.agg(F.max("chunk")).first()[0]
    while most:
        level = materialise(_composed(open_), "composed")
        closed = closed.union(level.where(F.col("cut").isNull()))
        open_ = level.where(F.col("cut").isNotNull())
        most = most // FAN_IN
    # one fragment a text is left: its prefix is the first group, and nothing stands behind the last common end
    first = open_.select("row", "doc_id", "chunk", F.lit(None).cast("long").alias("cut"), *[F.lit(None).cast("binary").alias(c) for c in
                         ("pa", "pea", "pb", "peb", "sa", "sea", "sb", "seb")], F.col("pa").alias("ga"), F.col("pea").alias("gea"),
                         F.col("pb").alias("gb"), F.col("peb").alias("geb"), F.lit(-1).cast("long").alias("place"))
    return materialise(_closed_packs(closed.union(first), chunk), "closed-packs")


_PAIRS_SQL = "pack long, whole boolean, number int, a long, b long, held long"


def _distinct_pairs(packs: DataFrame) -> DataFrame:
    """_PAIRS_SQL: each packed row's distinct pairs, and how many of its rows hold each."""
    def run(batches):
        for b in batches:
            for pack, whole, *blobs in zip(*(c.to_pylist() for c in b.columns)):
                a, second, held = (np.frombuffer(x, "<u4") for x in blobs)
                for at in range(0, len(a), 50_000):
                    part = slice(at, at + 50_000)
                    n = len(a[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pack, np.int64)), pa.array(np.full(n, whole)), pa.array(
                        np.arange(at, at + n, dtype=np.int32)), *(pa.array(x[part].astype(np.int64)) for x in (a, second, held))],
                        [f.split()[0] for f in _PAIRS_SQL.split(", ")])

    return packs.select("pack", "whole", "pa", "pb", "held").mapInArrow(run, _PAIRS_SQL)


def _pairs_of_long_texts(packs: DataFrame) -> DataFrame:
    """(a, b, held): how many long texts hold each pair, a text counted once for all its pieces."""
    def run(batches):
        for b in batches:
            for pieces, *blobs in zip(*(c.to_pylist() for c in b.columns)):
                a, second, sizes, numbers = (np.frombuffer(x, "<u4").astype(np.int64) for x in blobs)
                row = np.repeat(np.array([p["row"] for p in pieces], np.int64), sizes)
                yield pa.RecordBatch.from_pydict({"row": row, "a": a[numbers], "b": second[numbers]})

    each = packs.select("pieces", "pa", "pb", "sizes", "numbers").mapInArrow(run, "row long, a long, b long")
    return each.distinct().groupBy("a", "b").agg(F.count("*").alias("held"))


_SCORED_SQL = ("row long, doc_id long, place long, n_a long, n_b long, n_groups long, n_links long, text string, n_best long, count_sum long, whole boolean")


def _scored(packs: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per text or piece with n_best and count_sum, from the packed rows and the counts of their pairs, in order."""
    def run(batches):
        for b in batches:
            for whole, pieces, sizes, numbers, times, found in zip(*(b.column(c).to_pylist() for c in (
                    "whole", "pieces", "sizes", "numbers", "times", "counts"))):
                sizes, numbers, times = (np.frombuffer(x, "<u4").astype(np.int64) for x in (sizes, numbers, times))
                # counts stand in the order of their numbers, below zero where they are their A id's highest
                found = np.array(found or [0], np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                best = np.zeros(len(sizes), np.int64)
                total = np.zeros(len(sizes), np.int64)
                if len(numbers):
                    np.add.at(best, row, times * (found[numbers] < 0))
                    np.add.at(total, row, times * np.abs(found[numbers]))
                columns = [pa.array([p[f.name] for p in pieces], f.type) for f in _PIECE]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best), pa.array(total), pa.array([whole] * len(pieces))],
                                                 [f.split()[0] for f in _SCORED_SQL.split(", ")])

    joined = packs.select("pack", "whole", "pieces", "sizes", "numbers", "times").join(counts, "pack", "left")
    return joined.mapInArrow(run, _SCORED_SQL)


def _digests(pieces: DataFrame) -> DataFrame:
    """(row, sha): digests of long texts' groups, whose pieces pass once in their order."""
    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for row, group in itertools.groupby(rows, lambda r: r[0]):
            sha, before = hashlib.sha256(), ""
            for _, _, text in group:
                sha.update((before + text[:-1]).encode())
                before = ";"
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([sha.hexdigest()])], ["row", "sha"])

    return pieces.select("row", "place", "text").repartition("row").sortWithinPartitions("row", "place").mapInArrow(run, "row long, sha string")


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, RESULT and groups_sha256 of every row of docs (doc_id, text, ...).

    ``byte_level`` and ``pieces`` are tokenizer files.  Null and empty texts,
    and those whose bytes one of the tokenizers changes, have zeros and ''.
    Each row is a document of its own, also those that repeat another or have
    no doc_id.  Texts longer than ``chunk`` bytes are aligned by many tasks.
    More columns are ignored; an empty table gives no rows.
    """
    import public_tokenizers
    spark = docs.sparkSession
    python_ready(spark)
    encoded = materialise(_encoded(docs, byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES), chunk), "encoded")
    columns = [f.split(" ")[0] for f in ("pack", "whole", "pieces", "pa", "pb", "held", "sizes", "numbers", "times")]
    packs = encoded.where(F.col("pack").isNotNull()).select(*columns)
    chunks = encoded.where(F.col("c_row").isNotNull()).select(*[F.col(f"c_{f.split()[0]}").alias(f.split()[0]) for f in _CHUNK_SQL.split(", ")])
    long_packs = _long_texts(chunks, chunk)
    packs = packs.union(long_packs.select(*columns))

    each = materialise(_distinct_pairs(packs), "pairs")
    held = each.where("whole").select("a", "b", "held").union(_pairs_of_long_texts(long_packs))
    counts = materialise(held.groupBy("a", "b").agg(F.sum("held").alias("count")), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    marked = counts.join(highest, "a").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.when(
        F.col("count") == F.col("highest"), -F.col("count")).otherwise(F.col("count")).alias("count"))
    looked = each.join(marked, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb"))).groupBy("pack").agg(
        F.expr("transform(array_sort(collect_list(struct(number, count))), x -> x.count)").alias("counts"))
    scored = materialise(_scored(packs, looked), "scored")

    short = scored.where("whole").select("doc_id", *RESULT, F.col("text").alias("groups_sha256"))
    parts = scored.where("not whole")
    long = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in RESULT])
    digests = _digests(parts).select(F.col("row").alias("of"), "sha")
    long = long.join(digests, F.col("row") == F.col("of")).select("doc_id", *RESULT, F.col("sha").alias("groups_sha256"))
    return short.union(long)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over all ``documents``."""
    return align(documents(spark, sf_dir))
