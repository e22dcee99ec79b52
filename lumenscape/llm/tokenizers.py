"""Token ids of public tokenizer files, fast and exact, inside tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# The split pattern of byte-level BPE, and Unicode's White_Space characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Where the look-ahead of SPLIT matters: before the last character of a run of white space.
_CUT = re.compile(f"(?<=[{WHITE_SPACE}])(?=[{WHITE_SPACE}][^{WHITE_SPACE}])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id if this is byte-level BPE whose ids follow the merge order; else None."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    apart = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    plain = apart and model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain:
        return None
    letters, special = _byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids; none are put around a text, and the file's added tokens are known wherever a text has them.

    A byte-level BPE file is run with a split pattern free of look-ahead, on the text cut at added tokens and where the
    look-ahead would act; ids equal those of the `tokenizers` library, which serves all other files.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _byte_level_ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import tiktoken

    encode = tiktoken.Encoding("byte-level", pat_str=SPLIT.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ordinary(text: str) -> list[int]:
        parts = _CUT.split(text)
        return encode(text) if len(parts) == 1 else [i for part in parts for i in encode(part)]

    def ids(text: str) -> np.ndarray:
        if apart is None or not any(t in text for t in added):
            return np.array(ordinary(text), dtype=np.uint32)
        pieces = apart.split(text)
        return np.array([i for piece in pieces for i in ([added[piece]] if piece in added else ordinary(piece))], dtype=np.uint32)

    return ids
