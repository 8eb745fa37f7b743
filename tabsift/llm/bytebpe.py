"""Token ids of a byte-level BPE vocabulary file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the split of byte-level BPE into words.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, as the ``tokenizers`` file at ``path`` defines them.

    Strings of special tokens inside a text become those tokens, none are added. Where the file is
    plain byte-level BPE whose merges are ranked by id, the ids come from ``tiktoken``, which gives
    the same ones several times faster; any other file goes through ``tokenizers``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = _ranks(spec)
    if plain is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    encoding = tiktoken.Encoding(
        path, pat_str=PATTERN, mergeable_ranks=plain, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint32)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = (
        model["type"] == "BPE" and spec.get("normalizer") is None and split.get("type") == "ByteLevel"
        and split.get("use_regex") and not split.get("add_prefix_space")
        and not model.get("ignore_merges") and not model.get("dropout")
        and not any(t.get(k) for t in spec.get("added_tokens", ())
                    for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not usual:
        return None
    vocab, letters = model["vocab"], _alphabet()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab) - sum(
            t["content"] in vocab for t in spec.get("added_tokens", ())):
        return None
    names = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in names}
