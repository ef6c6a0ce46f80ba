"""Token ids of whole texts through caches of bounded size.

The vocabulary's pre-tokenizer never matches across white space, so the ids of a text are those of its words in order.
Words are looked up by hash; new words are cut into pieces (runs of letters, single digits, runs of other signs) for
a whole batch at once, and each new piece goes through the BPE model once. Words with anything beyond U+023F, an
apostrophe, a control or white space character, or more than LONGEST bytes go through the tokenizer itself. Results equal
Tokenizer.encode(text, add_special_tokens=False), but for two words of up to LONGEST bytes of one cache whose keyed 64-bit
hashes are equal, which nobody can bring about.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from stallmark.llm.kernels import Words, keyed_hashes

#: Entries after which a cache is emptied, and the longest word in bytes that is cached.
MOST_WORDS, MOST_PIECES, LONGEST = 400_000, 300_000, 256
#: The split pattern that pieces() carries out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, SIGN, SLOW = 1, 2, 3, 0


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the characters below U+0240; SLOW for those that cutting by kind does not do justice."""
    kind, low = np.zeros(0x240, np.uint8), np.zeros(0x240, np.int64)
    for c in range(33, 0x240):
        x = chr(c)
        y = x.lower()
        if x == "'" or x.isspace() or len(y) != 1 or ord(y) >= 0x240 or (ord(y) < 128) != (c < 128) or unicodedata.category(x) == "Cc":
            continue
        kind[c] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(y)[0], SIGN)
        low[c] = ord(y)
    return kind, low


KIND, LOW = _classes()


class Rows:
    """Lists of ids by hash, found by binary search."""

    def __init__(self):
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def __len__(self) -> int:
        return len(self.known)

    def new(self, uniq: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        return self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)

    def add(self, key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """key: sorted and new."""
        total = self.used + len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(total, np.uint32)])
        self.flat[self.used : total] = ids
        rows = len(self.at) - 1 + np.arange(len(n))
        self.at = np.concatenate([self.at, self.used + np.cumsum(n)])
        self.used = total
        to = np.searchsorted(self.known, key)
        self.known, self.row = np.insert(self.known, to, key), np.insert(self.row, to, rows)

    def get(self, uniq: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys on end, and where each key's begin (one entry more than keys)."""
        row = self.row[np.searchsorted(self.known, uniq)][inverse]
        begin, n = self.at[row], self.at[row + 1] - self.at[row]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends


def pieces(buf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of these sizes on end: where pieces begin, the word of each, and which words are SLOW. Lowers buf."""
    word = np.repeat(np.arange(len(size)), size)
    kind, lead = np.full(len(buf), SLOW, np.uint8), np.flatnonzero((buf >= 0xC2) & (buf <= 0xC8))
    plain = buf < 128
    code = buf[plain].astype(np.int64)
    kind[plain], buf[plain] = KIND[code], LOW[code]
    code = (buf[lead].astype(np.int64) & 31) << 6 | buf[lead + 1] & 63
    kind[lead] = kind[lead + 1] = KIND[code]
    buf[lead], buf[lead + 1] = 0xC0 | LOW[code] >> 6, 0x80 | LOW[code] & 63
    slow = np.bincount(word[kind == SLOW], minlength=len(size)) > 0
    head = np.ones(len(buf), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1]) | ((kind[1:] == DIGIT) & ((buf[1:] & 0xC0) != 0x80))
    begin = np.flatnonzero(head)
    return begin, word[begin], slow | (size > LONGEST)


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [s["type"] for s in kind["normalizer"]["normalizers"]]
        cut = kind["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or cut["type"] != "Split" or cut["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"{path}: only vocabularies that drop white space, lower case and split by {PATTERN} are handled")
        self.special = [t["content"].encode() for t in kind["added_tokens"]]
        self.letters = _byte_letters()
        self.words, self.pieces = Rows(), Rows()

    def _slow(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _learn(self, words: Words, key: np.ndarray, at: np.ndarray) -> None:
        """Adds the words at these places, whose hashes key are sorted and new."""
        size = words.end[at] - words.start[at]
        buf = words.buf[np.repeat(words.start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        raw = buf.tobytes()
        begin, word, slow = pieces(buf, size)
        ends = np.concatenate([[0], np.cumsum(size)])
        if any(s in raw for s in self.special):
            slow |= np.array([any(s in raw[ends[i] : ends[i + 1]] for s in self.special) for i in range(len(size))])
        if slow.any():
            ids = [self._slow(raw[ends[i] : ends[i + 1]]) for i in np.flatnonzero(slow).tolist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.words.add(key[slow], np.fromiter((x for own in ids for x in own), np.uint32, int(n.sum())), n)
        stop = np.append(begin[1:], len(buf))
        fast = ~slow[word]
        begin, stop, word = begin[fast], stop[fast], word[fast]
        length = stop - begin
        flat = buf[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        uniq, first, inverse = np.unique(keyed_hashes(flat, length), return_index=True, return_inverse=True)
        new = self.pieces.new(uniq)
        if new.any():
            model, letters, lowered = self.tokenizer.model, self.letters, buf.tobytes()
            parts = [lowered[b:e].decode("latin-1") for b, e in zip(begin[first[new]].tolist(), stop[first[new]].tolist(), strict=True)]
            ids = [[t.id for t in model.tokenize(p if p.isascii() else p.translate(letters))] for p in parts]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.pieces.add(uniq[new], np.fromiter((x for own in ids for x in own), np.uint32, int(n.sum())), n)
        ids, ends = self.pieces.get(uniq, inverse)
        n = np.bincount(word, np.diff(ends), len(size)).astype(np.int64)
        self.words.add(key[~slow], ids, n[~slow])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text begins (one entry more than texts)."""
        words = Words(texts)
        if len(self.words) > MOST_WORDS:
            self.words = Rows()
        if len(self.pieces) > MOST_PIECES:
            self.pieces = Rows()
        size = words.end - words.start
        key = words.hashes()
        long = np.flatnonzero(size > LONGEST)
        key[long] = np.arange(len(long))  # not cached: each is a word of its own, forgotten below
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        kept = self.words
        if len(long):
            self.words = Rows()
        new = self.words.new(uniq)
        if new.any():
            self._learn(words, uniq[new], first[new])
        ids, ends = self.words.get(uniq, inverse)
        self.words = kept if len(long) else self.words
        return ids, ends[words.first]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One set of caches per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
