"""Encoding by a tokenizers file, a batch of texts at a time, with bounded caches of pieces between blanks."""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np

from .common import held

#: Blanks at which a text may be cut: the vocabulary's splitter never joins text across them.
BETWEEN = re.compile(r"[^ \t\n\r]+")
#: Other characters at which str.split would cut too; texts that hold one are cut by the pattern.
OTHER_BLANKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
ASCII_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f"
#: Words of Latin letters in lower case, and marks behind a word, which the splitter parts from it as one run.
WORD = re.compile("[a-zß-öø-\u012f\u0131-\u017f]+")
MARKS = string.punctuation
#: Entries of each cache; a dict of up to 2^20 * 2 / 3 takes half the room of a larger one.
PIECES, CORES = 640_000, 640_000
#: Longer pieces, which may be whole texts, are forgotten after the batch.
HELD_CHARS = 64


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    The normaliser composes characters, turns runs of white space into one blank and letters into lower case, and the splitter drops
    blanks and parts marks from words. So the ids of a text are the ids of its pieces between blanks, one after the other, and a piece
    of Latin letters has the ids of its word in lower case and of the marks behind it. Each is encoded once; a cache is emptied when full.

    Words in lower case need neither normaliser nor splitter, which take half of the library's time, so they go to the file's model by
    blanks alone. Its tokens tell where a word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.pieces, self.cores, self.marks = Tokenizer.from_file(path), Tokenizer.from_file(path), {}, {}, {}
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.words.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _other_blanks(self, text: str) -> bool:
        return any(b in text for b in ASCII_BLANKS) if text.isascii() else OTHER_BLANKS.search(text) is not None

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case letters, all as one text."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.flatnonzero(self.ends[ids]) + 4
        if len(ends) != len(words):
            return self._whole(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [(BETWEEN.findall(t) if self._other_blanks(t) else t.split()) if t else [] for t in texts]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = set(chain.from_iterable(cut)).difference(self.pieces)  # repeats go first, which is cheaper than looking each up
        if new:
            self._learn(new)
        get = self.pieces.__getitem__
        out = [b"".join(map(get, own)) for own in cut]
        for piece in new:
            if len(piece) > HELD_CHARS:
                del self.pieces[piece]
        return out

    def _learn(self, new: set[str]) -> None:
        new = list(new)
        low = "\n".join(new).lower().split("\n")  # no piece holds a line feed
        own = [p.rstrip(MARKS) for p in low]
        if len(self.cores) > CORES:
            self.cores.clear()
        cores, pieces = self.cores, self.pieces
        unseen = [c for c in set(own).difference(cores) if WORD.fullmatch(c) and len(c) <= HELD_CHARS]
        for at in range(0, len(unseen), 4096):
            some = unseen[at : at + 4096]
            cores.update(zip(some, self._ids(some), strict=True))
        rest = []
        for piece, core, whole in zip(new, own, low, strict=True):
            ids = cores.get(core)
            if ids is None:
                rest.append(piece)
            elif core == whole:
                pieces[piece] = ids
            else:
                pieces[piece] = ids + self._marks(whole[len(core) :])
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            pieces.update(zip(some, self._whole(some), strict=True))

    def _marks(self, run: str) -> bytes:
        ids = self.marks.get(run)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            (ids,) = self._whole([run])
            if len(run) <= HELD_CHARS:
                self.marks[run] = ids
        return ids


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("encoder", path), lambda: Encoder(path))
