"""Token ids of text columns: distinct words are tokenized once for each worker and looked up after.

The tokenizers of the public vocabulary files split at white space, so a text's ids are those of its
white-space words in turn. A word is found again by its 64-bit hash.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from temblor.llm.words import CHUNK, Words, text_slices

KNOWN_WORDS = 2_000_000  # words kept for each worker; beyond that the store starts anew
_MARK = "<|startoftext|>"
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "|>"]] = True


class WordTokenizer:
    """Ids by a word-splitting BPE file; ``encode`` gives a ragged array for each slice of rows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(_MARK)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _new_ids(self, words: list[str]) -> list[list[int]]:
        """One call for many words, parted by a token that none of them holds."""
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        out: list[list[int]] = [[]] * len(words)
        for a in range(0, len(plain), 5_000):
            part = plain[a : a + 5_000]
            joined = _MARK.join(words[i] for i in part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            begin = 0
            for i, end in zip(part, ends, strict=True):
                out[i] = ids[begin:end]
                begin = end + 1
        for i in set(range(len(words))) - set(plain):
            out[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) > KNOWN_WORDS:
            self.clear()
        found = self._new_ids(words)
        length = np.array([len(f) for f in found], np.int64)
        flat = np.concatenate([np.asarray(f, np.uint16) for f in found]) if found else np.zeros(0, np.uint16)
        first = np.cumsum(length) - length + len(self.ids)
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.first = np.concatenate([self.first, first])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, column: pa.Array, limit: int = CHUNK):
        """(ids, row offsets) for consecutive slices of the column's rows."""
        for _, raw, offsets in text_slices(column, limit):
            words = Words(raw, offsets, cut=_cuts(raw))
            unique, where, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, unique)
            missing = np.ones(len(unique), bool)
            inside = place < len(self.hashes)
            missing[inside] = self.hashes[place[inside]] != unique[inside]
            if missing.any():
                if len(self.hashes) > KNOWN_WORDS:
                    self.clear()
                    missing[:] = True
                spans = where[missing]
                body = words.bytes
                new = [bytes(body[a:b]).decode("utf-8", "replace") for a, b in zip(words.starts[spans], words.ends[spans])]
                self._learn(unique[missing], new)
                place = np.searchsorted(self.hashes, unique)
            place = place[inverse] if len(unique) else place
            length = self.length[place]
            total = np.cumsum(length)
            begin = total - length
            ids = self.ids[np.repeat(self.first[place] - begin, length) + np.arange(int(total[-1]) if len(total) else 0)]
            bounds = np.concatenate([[0], total])[words.first]
            yield ids, bounds


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Punctuation that follows a letter: a token begins there, so fewer distinct words remain.

    Letters are a to z and the two-byte letters U+00C0 to U+00FF. The marks ``|>`` that end a special
    token's name stay with it.
    """
    cut = np.zeros(len(raw), bool)
    if len(raw) > 2:
        letter = _LETTER[raw | np.uint8(0x20)] & (raw < 0x80)
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[1:] = _PUNCTUATION[raw[1:]] & letter[:-1]
    return cut


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, with the words it has met."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
