"""Token ids of the public word BPE for many texts, a piece at a time.

The tokenizer lower-cases, drops white space and merges within pieces (words, digits, runs of signs) alone, so a text's
ids are those of its pieces in a row, and a piece seen before needs no work. New pieces of a batch are merged together,
in arrays, by the tokenizer's own table of merges. This covers texts of letters below U+0250, whose normal form and
lower case are plain; all other texts go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's own way to cut a lower-cased text, for the characters that ``_OTHER`` lets pass.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \n\t\r{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\n\t\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]|<\\|")
_NONE = np.int64(1) << 62


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a printable letter: printable ones as they are, others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """Keeps the ids of pieces, as bytes (little-endian unsigned 32 bits); the store is bounded."""

    MOST = 500_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 3, bool)  # whether a sentence may end with this token
        for token, k in vocab.items():
            self.ends[k] = token.endswith("</w>") and token[-5:-4] in (".", "!", "?")
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[f"{c}</w>"] for c in letters], np.int64)
        pairs = [(a, b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._rank = np.argsort(keys)
        self._keys = keys[self._rank]
        self.pieces: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece (not empty). Each round merges every piece's pair of lowest rank, the leftmost of equals."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._inner[flat]
        last = np.cumsum(sizes) - 1
        symbols[last] = self._last[flat[last]]
        who = np.arange(len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        while len(who):
            starts = np.cumsum(sizes) - sizes
            key = np.append(symbols[:-1] << 17 | symbols[1:], 0)
            key[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            best = np.where(self._keys[at] == key, self._rank[at] << 32 | np.arange(len(key)), _NONE)
            best = np.minimum.reduceat(best, starts)
            done = best == _NONE
            if done.any():
                words = symbols.astype("<u4").tobytes()
                for k, a, n in zip(who[done].tolist(), (4 * starts[done]).tolist(), (4 * sizes[done]).tolist()):
                    out[k] = words[a : a + n]
            place = best[~done] & 0xFFFFFFFF
            symbols[place] = self._made[best[~done] >> 32]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbols, sizes, who = symbols[keep], sizes[~done] - 1, who[~done]
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        cut: list[list[str] | str] = [t if _OTHER.search(t) else _PIECE.findall(t.lower()) for t in (t or "" for t in texts)]
        if len(self.pieces) > self.MOST:
            self.pieces.clear()
        known = self.pieces
        if new := [p for p in {p for c in cut if isinstance(c, list) for p in c} if p not in known]:
            known.update(zip(new, self.merge(new)))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), "<u4") if isinstance(c, list) else np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4") for c in cut]


_READY: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One for each worker process, with what it has learnt from earlier batches."""
    if path not in _READY:
        _READY[path] = WordBpe(path)
    return _READY[path]
