"""Public tokenizer files as encoders and byte tables; loaded once per worker process."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism


def public_path(name: str) -> str:
    """Where the installed tokenizer files are; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letter of byte-level BPE for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class ByteLevel:
    """A byte-level BPE file: ids of texts, and the bytes of ids.

    Where the ids are the order of the merges, tiktoken gives the same ids several times as fast; a file without that order,
    and a text that tiktoken refuses, go through the tokenizers library itself.
    """

    def __init__(self, path: str, specials_are_text: bool):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        by_id = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.specials}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes = [by_id.get(i, b"") for i in range(self.size)]
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self._path, self._plain, self._slow, self._fast = path, specials_are_text, None, None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and sorted(vocab[c] for c in letters) == list(range(256))
        if ordered and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            import public_tokenizers
            import tiktoken

            self._fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in by_id.items()}, special_tokens={} if specials_are_text else self.specials)

    def encode(self, text: str) -> list[int]:
        if self._fast is not None:
            try:
                return self._fast.encode_ordinary(text) if self._plain else self._fast.encode(text, allowed_special="all", disallowed_special=())
            except BaseException as error:  # a panic of the regular expression engine is no Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
            self._slow.encode_special_tokens = self._plain
        return self._slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of ids (U+2581 as a space, byte pieces as their byte)."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self._model.id_to_piece(i)) for i in range(self.size))]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


@functools.cache
def byte_level(path: str, specials_are_text: bool) -> ByteLevel:
    return ByteLevel(path, specials_are_text)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)
