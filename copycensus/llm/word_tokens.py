"""Token ids of the lower-casing word vocabulary, inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from copycensus.llm.common import worker_memory

WORD_BPE = "word_bpe_49k"

#: Words whose ids a worker remembers. Further words are encoded each time they come, with the same result.
REMEMBERED = 150_000
#: Texts are encoded in pieces of about so many characters, cut before a space.
PIECE_CHARS = 1 << 20

# How the vocabulary splits lower-cased text, and its special tokens. The classes are those
# of letters, numbers and white space up to U+00FF.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
_BEYOND = re.compile("[^\0-\xff]")


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable,
    else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    shown = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def _parts(text: str, chars: int) -> Iterator[str]:
    """The text in pieces that begin at a space. No token crosses white space."""
    start = 0
    while start < len(text):
        stop = text.find(" ", start + chars)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop]
        start = stop


class WordEncoder:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, as unsigned 32-bit integers.

    That library takes most of its time to normalise and split; here texts up to U+00FF are lower-cased and
    split by one regular expression, and its model is asked once for each word that comes up. Runs between
    spaces with other characters or a special token go through the whole library.
    """

    def __init__(self, path: str, piece_chars: int = PIECE_CHARS) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.piece_chars = self.library.model, piece_chars
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.shown = str.maketrans({b: c for b, c in enumerate(printable_bytes())})
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word.encode().decode("latin-1").translate(self.shown)
            found = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if len(self.words) < REMEMBERED:
                self.words[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        words = _SPLIT.findall(text.lower())
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        if not _BEYOND.search(text) and not _SPECIAL.search(text):
            return self._plain(text)
        out, plain = [], []
        for run in text.split(" "):
            if _BEYOND.search(run) or _SPECIAL.search(run):
                out += [self._plain(" ".join(plain)), self._whole(run)]
                plain = []
            else:
                plain.append(run)
        return b"".join([*out, self._plain(" ".join(plain))])

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._piece, _parts(text, self.piece_chars))), "<u4")


def word_encoder(folder: str | None = None, name: str = WORD_BPE) -> Callable[[str], np.ndarray]:
    """The encoder of this worker; ``folder`` holds the vocabulary file, by default ``public_tokenizers``."""
    import os

    import public_tokenizers

    memory, key = worker_memory(), ("words", folder, name)
    if key not in memory:
        memory[key] = WordEncoder(os.path.join(folder, f"{name}.json") if folder else public_tokenizers.path(f"{name}.json"))
    return memory[key]
