"""Token ids of whole texts by a public tokenizer, word by word with a memo.

The tokenizer splits at white space, so a text's ids are those of its white-space separated chunks in turn. A worker keeps the ids of
the chunks of up to LONGEST bytes that it met first (the frequent ones), up to a number: so the memo's bytes are bounded, also where
texts without white space are one chunk each. A new chunk of letters, then punctuation, goes straight to the
tokenizer's model; whatever else there is goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: How byte-level models write bytes: printable ones as themselves, the others from U+0100 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: Lower-case letters that no normalisation changes, then ASCII punctuation but the apostrophe and anything from U+0180 on.
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)?([!-&(-/:-@\\[-`{-~]+)?")
#: Bytes of the longest chunk that is kept.
LONGEST = 64
_LOADED: dict[tuple[str, int], WordIds] = {}


class WordIds:
    """For a tokenizer that drops white space, lower-cases, splits letters, digits and punctuation apart, and marks word ends."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.most = self.whole.model, most
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, most: int = 500_000) -> WordIds:
        """One for each process and path."""
        if (path, most) not in _LOADED:
            _LOADED[path, most] = cls(path, most)
        return _LOADED[path, most]

    def _full(self, s: str) -> bytes:
        return np.array(self.whole.encode(s, add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, s: str) -> bytes:
        mapped = s if s.isascii() else "".join(_BYTE[b] for b in s.encode())
        return np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()

    def _new(self, chunk: bytes) -> bytes:
        s = chunk.decode(errors="replace")
        m = _SIMPLE.fullmatch(s.lower()) if "<|" not in s and max(s) < "ƀ" else None
        if m is None:
            ids = self._full(s)
        else:
            word, mark = m[1], m[2]
            ids = b""
            if word:
                key = word.encode()
                ids = self.memo.get(key) or self._letters(word)
                if mark and len(self.memo) < self.most and len(key) <= LONGEST:
                    self.memo[key] = ids
            if mark:
                if mark not in self.marks:
                    got = self._full(mark)
                    if len(self.marks) < 10_000 and len(mark) <= LONGEST:
                        self.marks[mark] = got
                else:
                    got = self.marks[mark]
                ids += got
        if len(self.memo) < self.most and len(chunk) <= LONGEST:
            self.memo[chunk] = ids
        return ids

    def encode(self, text: bytes | None) -> np.ndarray:
        """The ids of a whole text (None: none), as if the tokenizer had read it in one piece."""
        text = text or b""
        chunks = (text if b"<|" in text else text.lower()).split()
        ids = list(map(self.memo.get, chunks))
        if None in ids:
            ids = [self._new(c) if x is None else x for c, x in zip(chunks, ids, strict=True)]
        return np.frombuffer(b"".join(ids), self.dtype)
