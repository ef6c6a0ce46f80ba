"""Token ids of whole texts under a byte-level BPE vocabulary, through caches of bounded size.

A text falls into units: a word with the space right before it, cut where an ASCII sign follows an ASCII letter, or what
white space is left between two words. The vocabulary's own pattern never matches across their borders, so the ids of a
text are those of its units in order. Equal units of a slice of text are found by Arrow's dictionary encoding, which
compares bytes; a unit that the cache does not know is cut by that pattern and its pieces go through the BPE model. A text that spells a special token goes through the tokenizer
itself. Results equal Tokenizer.encode(text, add_special_tokens=False).ids.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Entries after which the cache is emptied, and the longest unit in bytes that is cached.
MOST_UNITS, LONGEST = 500_000, 128
#: The pattern by which a ByteLevel pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII as UTF-8: two bytes, or three of which the last lies in a range.
WIDE_SPACE = ((0xC2, 0x85, None), (0xC2, 0xA0, None), (0xE1, 0x9A, (0x80, 0x80)), (0xE2, 0x80, (0x80, 0x8A)), (0xE2, 0x80, (0xA8, 0xA9)), (0xE2, 0x80, (0xAF, 0xAF)), (0xE2, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, (0x80, 0x80)))

#: ASCII letters, and ASCII signs that never stand in one piece with a letter before them.
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


def unit_starts(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin in the texts that begin at first[:-1] and lie on end in buf."""
    n = len(buf)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    lead = space.copy()  # the first byte of each white space character
    if n > 1 and (buf >= 0xC2).any():
        for a, b, last in WIDE_SPACE:
            at = np.flatnonzero((buf[:-1] == a) & (buf[1:] == b))
            if last:
                at = at[at + 2 < n]
                at = at[(buf[at + 2] >= last[0]) & (buf[at + 2] <= last[1])]
                space[at + 2] = True
            space[at] = space[at + 1] = lead[at] = True
    head = np.zeros(n + 1, bool)
    head[first] = True
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    start = head.copy()
    into_word = change[~space[change] & ~head[change]]
    start[change[space[change]]] = True
    leads = np.flatnonzero(lead)
    last = leads[np.searchsorted(leads, into_word) - 1]  # the last white space character before each word
    start[last] = True
    start[into_word[buf[last] != 32]] = True
    start[1:n] |= SIGN[buf[1:]] & LETTER[buf[:-1]]
    return np.flatnonzero(start[:n])


class ByteIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cut = kind["pre_tokenizer"]
        if kind["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"{path}: only vocabularies whose texts go byte by byte, cut by {PATTERN}, are handled")
        self.special = [t["content"].encode() for t in kind["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut, self.letters, self.model = regex.compile(PATTERN), _alphabet(), self.tokenizer.model
        self.units: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _unit(self, unit: bytes) -> bytes:
        pieces = [unit] if unit.isalpha() or unit[1:].isalpha() and unit[0] == 32 else [p.encode() for p in self.cut.findall(unit.decode())]
        got = self._packed([t.id for p in pieces for t in self.model.tokenize(p.decode("latin-1").translate(self.letters))])
        if len(unit) <= LONGEST:
            if len(self.units) >= MOST_UNITS:
                self.units.clear()
            self.units[unit] = got
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text; a null text counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(buf):
            return [b""] * len(texts)
        starts = unit_starts(buf, offsets)
        ends = np.append(starts, len(buf))
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(buf)]).dictionary_encode()
        known = self.units
        ids = pa.array([known[u] if u in known else self._unit(u) for u in cells.dictionary.to_pylist()], pa.large_binary()).take(cells.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, offsets)]
        raw = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        out = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        whole = buf.tobytes()
        if any(s in whole for s in self.special):
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in whole[a:b] for s in self.special):
                    out[i] = self._packed(self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids)
        return out


_loaded: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """One set of caches per Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteIds(path)
    return _loaded[path]
