"""Byte-level BPE: ids of whole texts as the tokenizers library gives them, by the cheapest way that provably agrees with it.

The library is the authority. It spends about 0.8 CPU seconds a MB, most of it on offsets that no operator
here uses. Where the tokenizer file allows a proof (see exact_core), the same merges run in tiktoken's core
at a sixth of that; every other text goes through the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Fixed value: the split pattern of byte-level BPE tokenizers of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here letters, digits and white space are the same in every Unicode version the libraries may carry.
PLAIN = re.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Letters(dict):
    """For str.translate: the byte letters of a character's UTF-8 bytes."""

    def __init__(self):
        self.of = byte_letters()

    def __missing__(self, point: int) -> str:
        out = self[point] = "".join(self.of[b] for b in chr(point).encode("utf-8", "surrogatepass"))
        return out


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def exact_core(path: str, tokenizer):
    """A tiktoken core with the file's merges, or None if the two could differ.

    The library merges listed pairs, the core any neighbours whose bytes together are a token. They can only
    differ at a token that the library does not make of its own bytes (on whose bytes the listed merges get
    stuck); so the core is used if the library makes every token of the vocabulary of its own bytes, ids
    follow the order of the merges, and nothing but the usual splitting stands before the model.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab, back = model["vocab"], {letter: b for b, letter in enumerate(byte_letters())}
    merged = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    if merged != sorted(set(merged)) or len(vocab) != 256 + len(merged) or min(merged, default=256) != 256:
        return None
    if any(len(made := tokenizer.model.tokenize(token)) != 1 or made[0].id != at for token, at in vocab.items()):
        return None
    ranks = {bytes(back[letter] for letter in token): at for token, at in vocab.items()}
    return tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.core = exact_core(path, self.tokenizer)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None

    def encode(self, text: str | None) -> np.ndarray:
        """Ids, without special tokens around them, as uint32; none for a null text."""
        if not text:
            return np.empty(0, np.uint32)
        if self.core is None or PLAIN.search(text) or self.special and self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.core.encode_to_numpy(text, disallowed_special=())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each file in a Python worker."""
    return Encoder(path)
