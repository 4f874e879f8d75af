"""Token ids of public vocabularies: exact, with a faster path for plain Latin text.

``WordBpe`` gives the ids that the ``tokenizers`` library gives for a vocabulary of word-end BPE. Its fast path runs the
same merges through tiktoken: a word's last symbol, which carries the word end, is written as its byte and the control
character 1, and each merge gets the rank of its place in the list. Texts with characters beyond Latin-1 or with control
characters go through the library itself, since normalisation and character classes matter there.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
_MARK = "\x01"
#: How the vocabulary cuts words: for plain text in lower case, where letters, numbers and spaces are these.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t\n\ra-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Ids of a word-end BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.fast, self.ids = self._compile(model) if model.get("end_of_word_suffix") == "</w>" else (None, None)

    @cached_property
    def slow(self) -> Tokenizer:
        """The library's own encoder, loaded when a text needs it."""
        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True  # their strings in a text are ordinary text
        return own

    @staticmethod
    def _compile(model: dict) -> tuple[tiktoken.Encoding | None, np.ndarray | None]:
        letters, vocab = _byte_letters(), model["vocab"]

        def raw(symbol: str) -> bytes:
            end = symbol.endswith("</w>")
            return bytes(letters[c] for c in (symbol[:-4] if end else symbol)) + b"\x01" * end

        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(symbol: bytes, token: int) -> None:
            if symbol in ranks:
                raise ValueError("two merges make one symbol")
            ranks[symbol] = len(ids)
            ids.append(token)

        try:
            back = {b: c for c, b in letters.items()}
            for b in range(256):
                add(bytes([b]), vocab.get(back[b], -1))
            for b in range(256):  # closing a word comes before all merges
                if b != 1:
                    add(bytes([b, 1]), vocab.get(back[b] + "</w>", -1))
            for merge in model["merges"]:
                left, right = merge if isinstance(merge, list) else merge.split(" ")
                add(raw(left) + raw(right), vocab[left + right])
        except (KeyError, ValueError):
            return None, None  # not of this form: the library does it all
        return tiktoken.Encoding("word_bpe", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}), np.array(ids, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not _PLAIN.search(text):
            words = _WORDS.findall(text.lower())
            if not words:
                return np.zeros(0, np.uint32)
            return self.ids[self.fast.encode_to_numpy(_MARK.join(words) + _MARK)].astype(np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def vocabulary_path(name: str) -> str:
    """Where the public vocabularies lie; operators take a path, this only names the usual one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class BytePairs:
    """Ids of a byte-level rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0
