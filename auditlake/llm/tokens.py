"""Token ids of texts by a public byte-level BPE file, batch by batch inside Spark tasks."""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"
#: Characters that are never white space; a run of them separated by single blanks splits safely at each blank.
_SAFE = "!-~À-ɏ"
_LINE = re.compile(f"[{_SAFE}]+(?: [{_SAFE}]+)*")
_TEXT = re.compile(f"{_LINE.pattern}(?:\n{_LINE.pattern})*")
#: Marks, which no safe word holds, of the end of a text and of a part that is encoded whole.
_END, _BLOCK = "\x01", "\x02"
_MARKS = (_END, _BLOCK)
#: One word of letters, or of a final group of punctuation, after at most one blank: pre-tokens of their own.
_PLAIN = re.compile("(?m)^(?:( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]*)|.*)$")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, the same as encoding each whole text with the library.

    The pre-tokeniser never joins a non-blank character to what follows a
    blank or line break, so a text is the concatenation of its words, each
    with the blank before it; distinct words are encoded by the library once
    and remembered (up to ``remember`` of them).  Lines with any other white
    space or unusual characters are encoded whole, together with the line
    after them, whose first character decides how white space is split.
    """

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _cut(self, text: str, blocks: list[str]) -> list[str]:
        """Words with the blank before them and line breaks; parts to encode whole go to ``blocks``, by their number here."""
        if _TEXT.fullmatch(text):
            return [text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")]
        pieces: list[str] = []
        lines, held = text.split("\n"), None
        for i, line in enumerate(lines):
            safe = _LINE.fullmatch(line) is not None
            if held is None and safe:
                if i:
                    pieces.append("\n")
                pieces.append(line.replace(" ", "\x00 "))
            elif held is None:
                held = i
            elif safe:
                pieces.append(f"{_BLOCK}{len(blocks)}")
                blocks.append("\n" * (held > 0) + "\n".join(lines[held:i + 1]))
                held = None
        if held is not None:
            pieces.append(f"{_BLOCK}{len(blocks)}")
            blocks.append("\n" * (held > 0) + "\n".join(lines[held:]))
        return pieces

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            self.marks.clear()
        self.known["\n"] = array("I", [self.line_break]).tobytes()
        whole, words, parts = [], [], []
        for p, (word, mark) in zip(new, _PLAIN.findall("\n".join(new))):
            if not word:
                words.append(p)
            elif not mark:
                self.known[p] = self._merged(word)
            else:
                if (after := self.marks.get(mark)) is None:
                    after = self.marks[mark] = self._merged(mark)
                self.known[p] = (self.known.get(word) or self._merged(word)) + after
        for at in range(0, len(words), 1024):
            part = words[at:at + 1024]
            joined = "\n".join(part)
            if any(s in joined for s in self.special):
                whole += [p for p in part if any(s in p for s in self.special)]
                part = [p for p in part if not any(s in p for s in self.special)]
                joined = "\n".join(part)
            parts.append((part, joined))
        # words are encoded many at a time, with line breaks between them, which are tokens of their own
        for (part, _), ids in zip(parts, self._ids([joined for _, joined in parts])):
            ends, at = [*(i for i, t in enumerate(ids) if t == self.line_break), len(ids)], 0
            for piece, end in zip(part, ends):
                self.known[piece] = array("I", ids[at:end]).tobytes()
                at = end + 1
        for piece, ids in zip(whole, self._ids(whole)):
            self.known[piece] = array("I", ids).tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of one pre-token by the library's merges, without its splitter."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        elif word[0] == " ":
            word = _BYTE_LETTERS[32] + word[1:]
        return array("I", [t.id for t in self.bpe(word)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text.  Arrow finds the distinct words of the batch; only those are looked up or encoded."""
        if not texts:
            return []
        blocks: list[str] = []
        cut = [x for t in texts for x in ([*self._cut(t, blocks), _END] if t else [_END])]
        pieces = pc.split_pattern(pa.array(["\x00".join(cut)], pa.large_string()), "\x00").flatten().dictionary_encode()
        code, names = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary.to_pylist()
        ids = list(map(self.known.get, names))
        absent = [at for at, i in enumerate(ids) if i is None]
        new = [names[at] for at in absent if names[at][0] not in _MARKS and names[at] != "\n"]
        self._learn(new)
        whole = [array("I", i).tobytes() for i in self._ids(blocks)]
        for at in absent:
            n = names[at]
            ids[at] = b"" if n == _END else whole[int(n[1:])] if n[0] == _BLOCK else self.known[n]
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        start, length = (np.cumsum(size, dtype=np.int32) - size)[code], size[code]
        ends = np.cumsum(length, dtype=np.int32)
        out = flat[np.repeat(start - ends + length, length) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        stops = (4 * ends.astype(np.int64)[code == names.index(_END)]).tolist()
        return [out[a:b] for a, b in zip([0, *stops], stops)]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, so that remembered words outlive a batch."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def encode_column(texts, path: str, at_once: int = 4096, chars: int = 12_000_000):
    """Yield the id bytes of each text, encoding up to ``at_once`` texts or about ``chars`` characters together."""
    enc, held, size = encoder(path), [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if len(held) >= at_once or size >= chars:
            yield from enc.encode(held)
            held, size = [], 0
    yield from enc.encode(held)
