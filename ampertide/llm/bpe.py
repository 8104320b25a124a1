"""Byte-level BPE with the vocabulary of a tokenizers file.

`encoder(path)` reads the file's vocabulary once per worker. Files of the plain byte-level kind
(no normaliser, no post-processing, the usual split pattern) run on tiktoken, which gives the
same ids several times faster; any other file runs on the tokenizers library itself.
"""

from __future__ import annotations

import json

import numpy as np

# Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of a text as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        model = spec.get("model") or {}
        self.fast = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        )
        # Ids of parts of a text can be joined where a space parts two letters, unless a special
        # token may span that place.
        self.reusable = self.fast and not any(" " in a["content"] for a in added)
        if self.fast:
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
            special = {a["content"]: a["id"] for a in added}
            self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.table = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.core = Tokenizer.from_file(path)
            self.core.no_truncation()
            self.core.no_padding()

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            return self.core.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.core.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if self.fast:
            return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return self.core.decode(ids.tolist(), skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
