"""Token ids of the public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import base64
import functools

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@functools.cache
def _encoder(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str = VOCABULARY) -> list[int]:
    """The ids that the ``tokenizers`` file of the same vocabulary gives, its special token in the text included."""
    plain = _encoder(name).encode_ordinary
    if SPECIAL not in text:
        return plain(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            ids.append(SPECIAL_ID)
        ids += plain(part)
    return ids


def encode_array(text: str, closing: int) -> np.ndarray:
    ids = encode(text)
    ids.append(closing)
    return np.array(ids, dtype="<u4")
