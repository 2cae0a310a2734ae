"""Token ids by a public byte-level vocabulary file."""

from __future__ import annotations

import json
import sys
import types

TOKENIZER = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them, the file's special tokens included.

    tiktoken merges the file's vocabulary by rank, at four times the speed of the
    tokenizers library (that the ids are the same is checked in the tests).
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in self.special}
        self._allowed = set(self.special)
        self._coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        if any(s in text for s in self.special):
            return self._coder.encode(text, allowed_special=self._allowed, disallowed_special=())
        return self._coder.encode_ordinary(text)


def load_encoder(path: str | None = None) -> Encoder:
    """The encoder of a vocabulary file; without a path that of the public 50k vocabulary. A worker loads each file once."""
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    kept = sys.modules.setdefault("_veriloom_encoders", types.ModuleType("_veriloom_encoders")).__dict__  # functions travel by value, so a global of this module would be new in every task
    if path not in kept:
        kept[path] = Encoder(path, public_tokenizers.PATTERN)
    return kept[path]
