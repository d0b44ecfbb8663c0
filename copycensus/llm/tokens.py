"""Token ids of texts, inside tasks."""

from __future__ import annotations

from collections.abc import Callable

from copycensus.llm.common import worker_memory

BYTE_BPE = "byte_bpe_50k"
#: Of this vocabulary; the ``tokenizers`` library gives it one id wherever it stands in a text.
SPECIAL = "<|endoftext|>"


def _load(folder: str | None, name: str, special: bool) -> Callable[[str], list[int]]:
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def path(file: str) -> str:
        return os.path.join(folder, file) if folder else public_tokenizers.path(file)

    exact = Tokenizer.from_file(path(f"{name}.json"))
    exact.encode_special_tokens = not special
    with open(path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        if not special or SPECIAL not in text:
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the native code on odd input is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def encoder(folder: str | None = None, name: str = BYTE_BPE, special: bool = True) -> Callable[[str], list[int]]:
    """The ids that ``Tokenizer.from_file(name + ".json")`` gives without special tokens.

    Both libraries hold the same vocabulary and split alike, and ``tiktoken`` takes a quarter of the
    time. Texts with the special token's own string go through ``tokenizers``; with ``special=False``
    that string is text like any other. ``folder`` holds the vocabulary files; by default those of
    the installed ``public_tokenizers``.
    """
    memory = worker_memory()
    key = ("encoder", folder, name, special)
    if key not in memory:
        memory[key] = _load(folder, name, special)
    return memory[key]
