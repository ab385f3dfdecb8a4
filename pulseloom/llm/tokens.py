"""Token ids of whole texts by the `tokenizers` library, memoised by the pieces that its vocabulary cuts a text into.

The vocabulary lowers a text, drops white space and cuts it into runs of letters, single digits and runs of marks, so a
text's ids are the ids of its pieces laid end to end. A worker keeps the ids of the pieces it has met, as little-endian
32-bit bytes, and asks the library for the rest only. Texts with characters beyond ASCII and the letters of Latin-1 are
not cut here but at white space, or not at all.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces that a worker remembers, some 250 bytes each; when there are more it starts anew, which costs time and changes
#: nothing.
MEMORY = 900_000
#: Texts that are cut and looked up at a time, so that their pieces stay in the processor's cache.
GROUP = 50

#: The letters whose lower case and composition are one character each.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0153"
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]")
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: str.split() parts at these four too, the vocabulary does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    def __init__(self, tokenizer, memory: int = MEMORY):
        self.tokenizer = tokenizer
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def _batch(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 4096):
            out += [np.array(made.ids, "<u4").tobytes() for made in self.tokenizer.encode_batch(chunks[i : i + 4096], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text."""
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        of, ids = np.array(made.word_ids, np.int64), np.array(made.ids, "<u4")
        cuts = np.flatnonzero(np.diff(of)) + 1
        if len(cuts) + 1 != len(words):  # a letter that does not stay one letter
            return self._batch(words)
        data, at = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _pieces(self, text: str) -> list[str] | None:
        if not _OTHER.search(text) and "<|" not in text:
            return _PIECE.findall(text.lower())
        return None if _NOT_SPACE.search(text) else text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian."""
        return [ids for i in range(0, len(texts), GROUP) for ids in self._encode_group(texts[i : i + GROUP])]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        here = set().union(*[p for p in pieces if p])
        if len(self.known) + len(here) > self.memory:
            self.known.clear()
        new = here.difference(self.known)
        if new:
            words = list(filter(str.isalpha, new))
            others = list(new.difference(words))
            self.known.update(zip(words, self._words(words) if words else [], strict=True))
            self.known.update(zip(others, self._batch(others), strict=True))
        find = self.known.__getitem__
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if p is None else b"".join(map(find, p)) for t, p in zip(texts, pieces, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(name: str, memory: int = MEMORY) -> ChunkEncoder:
    """The worker's encoder of a vocabulary, a file name of the public tokenizers or a path, with so much memory."""
    if name not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = ChunkEncoder(Tokenizer.from_file(str(path)))
    _encoders[name].memory = memory
    return _encoders[name]
