"""Token ids of a public tokenizer file, and documents cut into pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

END = 0


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizer of the file gives them without special tokens.

    A byte-level file whose merges stand in the order of their ids is run by
    its ranks, which is several times faster and gives the same ids; texts with
    the string of an added token, and all other files, go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        said = json.load(open(path, encoding="utf-8"))
        self.added = [x["content"] for x in said.get("added_tokens", [])]
        self.fast = self._ranked(said)

    def _ranked(self, said: dict):
        import public_tokenizers
        import tiktoken

        model, pre = said["model"], said.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and said.get("normalizer") is None
        if not plain or not model.get("merges"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            return None
        of = _bytes_of()
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        if min(ids) < max(ranks[bytes([b])] for b in range(256)):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def document(enc: Encoder, text: str | None) -> np.ndarray:
    """A document's ids, ended by END."""
    return np.array([*enc.ids(text or ""), END], np.uint32)


def cuts(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a document's pieces: all but the first have the full length."""
    at = n - (-(-n // most) - 1) * most
    yield 0, at
    while at < n:
        yield at, at + most
        at += most
