"""Token ids of whole texts with a byte-level BPE file of the tokenizers library, many texts at once.

The library splits a text into pieces and merges inside each piece alone, so a piece always has the same ids.
Here the split is found for a whole batch with array operations, each piece is looked up by a 64-bit hash, and only pieces
not met before go to the library's model. The class of each character and the stand-in for each byte are asked of
the library's own splitter. Added tokens of the file (as ``<|endoftext|>``) are cut out of a text first, as the library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from tablewise.llm.arrays import pieces, span_hashes

_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_BASE = 0xD6E8FEB86659FD93
#: The endings that the split keeps in one piece with their apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Encoder:
    """Ids of texts. ``most`` bounds the pieces that are remembered."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or "ByteLevel" not in repr(self.library.pre_tokenizer):
            raise ValueError("a byte-level file without normalisation is needed")
        added = self.library.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("a file whose added tokens stand for exactly their own text is needed")
        self.added = {x.content: i for i, x in added.items()}
        # the library looks for tokens that are not normalised first, and for the longest at each place
        kinds = [sorted((x.content for x in added.values() if x.normalized == k), key=len, reverse=True) for k in (False, True)]
        self.tokens = [re.compile("|".join(map(re.escape, x))) for x in kinds if x]
        self.most = most
        self.stand_in = {}
        for c in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x400)]:  # every byte that UTF-8 has
            shown = "".join(x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(chr(c)))
            self.stand_in.update(zip(chr(c).encode(), shown, strict=True))
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count, self.pool, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def split(self, text: str) -> int:
        return len(self.library.pre_tokenizer.pre_tokenize_str(text))

    def classify(self, chars: np.ndarray) -> np.ndarray:
        found = self.classes[chars]
        if (found == _UNKNOWN).any():
            for c in np.unique(chars[found == _UNKNOWN]).tolist():
                x = chr(c)
                kinds = [k for k, y in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")) if self.split(y + x + y) == 1]
                self.classes[c] = kinds[0] if kinds else _SPACE
            found = self.classes[chars]
        return found

    def marked(self, text: str, chars_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First characters of the added tokens in the texts, and what follows their last ones."""
        found: list[tuple[int, int]] = []
        for pattern in self.tokens:
            if pattern.search(text) is None:
                continue
            cuts = sorted({*chars_before.tolist(), *(x for span in found for x in span)})
            taken = {lo for lo, _ in found}
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo not in taken:
                    found += [(lo + m.start(), lo + m.end()) for m in pattern.finditer(text[lo:hi])]
        spans = np.array(sorted(found), np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def starts(self, chars: np.ndarray, kinds: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index of the first character of each piece. ``docs``: the first character of each text that has any."""
        n = len(chars)
        new = np.ones(n + 1, bool)
        new[1:n] = kinds[1:] != kinds[:-1]
        new[docs] = True
        opens = new[:n].copy()
        doc = np.zeros(n + 1, bool)
        doc[docs], doc[n] = True, True
        blank = chars == 0x20
        space = kinds == _SPACE
        # a blank goes with what follows it
        after = np.zeros(n, bool)
        after[1:] = blank[:-1] & ~doc[1:n]
        opens[after & ~space] = False
        # of several white characters the last stands apart from the others if something follows
        last = space & new[1:] & ~doc[1:]
        opens[last] = True
        # apostrophe and ending
        for i in np.flatnonzero((chars == 0x27) & new[:n] & ~after).tolist():
            for ending in ENDINGS:
                end = i + 1 + len(ending)
                if end <= n and all(chars[i + 1 + k] == ord(c) for k, c in enumerate(ending)) and not doc[i + 1 : end].any():
                    opens[i + 1 : end] = False
                    if end < n:
                        opens[end] |= kinds[end] == _LETTER
                    break
        return np.flatnonzero(opens)

    def lookup(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Row in the memory of each (distinct) hash."""
        if len(self.keys) + len(hashes) > self.most:
            self.forget()
        at = np.searchsorted(self.keys, hashes)
        missing = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != hashes[inside]
        if missing.any():
            which = np.flatnonzero(missing)
            merge = self.library.model.tokenize
            given = [text_of(i) for i in which.tolist()]
            found = [[self.added[x]] if x in self.added else [y.id for y in merge(x.encode().decode("latin-1").translate(self.stand_in))] for x in given]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((x for y in found for x in y), np.uint32, int(sizes.sum()))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            first = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            order = np.argsort(hashes[which])
            at = np.searchsorted(self.keys, hashes[which][order])
            self.keys, self.first, self.count = (np.insert(a, at, b[order]) for a, b in ((self.keys, hashes[which]), (self.first, first), (self.count, sizes)))
            at = np.searchsorted(self.keys, hashes)
        return at

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin."""
        raw = data.tobytes()
        try:
            text = raw.decode()
            chars_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        except UnicodeDecodeError:
            parts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            text, chars_before = "".join(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        docs = chars_before[:-1][chars_before[:-1] < chars_before[1:]]
        token, after = self.marked(text, chars_before)
        if len(token):  # what is before and after an added token is split as a text of its own
            begins = self.starts(chars, self.classify(chars), np.union1d(docs, np.append(token, after[after < len(chars)])))
            inside = np.searchsorted(token, begins) - 1
            begins = begins[(inside < 0) | (begins >= after[inside])]
        else:
            begins = self.starts(chars, self.classify(chars), docs)
        ends = np.append(begins[1:], len(chars))
        codes, distinct = pd.factorize(span_hashes(chars.astype(np.uint64) + np.uint64(1), begins, ends, _BASE))
        sample = np.empty(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        row = self.lookup(distinct, lambda i: text[begins[sample[i]] : ends[sample[i]]])[codes]
        sizes = self.count[row]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.first[row] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(begins, chars_before)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids and offsets of runs of texts of a column; null is empty."""
    own = encoder(path)
    for first, data, offsets in pieces(column):
        yield first, *own.ids(data, offsets)
