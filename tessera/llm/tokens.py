"""Token ids of a byte-level BPE vocabulary in the JSON format of the tokenizers library.

Pieces and added tokens are read from that one file and encoded with tiktoken, which gives the ids of tokenizers (tested)
at four times the speed. Its pattern backtracks over long white space and gives up on some texts; those go to tokenizers
itself, which reads the same file and takes them in linear time.
"""

from __future__ import annotations

import json

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class ByteTokens:
    """``added``: the strings of added tokens in a text are these tokens; else they are plain text."""

    def __init__(self, path: str, added: bool):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.path, self.added, self._slow = path, added, None
        extra = {x["content"]: x["id"] for x in read["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_letters())}
        # a vocabulary gives its ids in the order of the merges, which is what the encoder ranks pieces by
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in read["model"]["vocab"].items() if piece not in extra}
        self.pieces = np.full(max([*ranks.values(), *extra.values()]) + 1, b"", object)
        for raw, i in ranks.items():
            self.pieces[i] = raw
        for text, i in extra.items():
            self.pieces[i] = text.encode()
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=extra)

    def encode(self, text: str) -> list[int]:
        try:
            return self._fast.encode(text, allowed_special="all" if self.added else set(), disallowed_special=())
        except ValueError:  # the pattern ran out of its stack
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
                self._slow.encode_special_tokens = not self.added
            return self._slow.encode(text, add_special_tokens=False).ids


_known: dict[tuple[str, bool], ByteTokens] = {}


def byte_tokens(path: str, added: bool) -> ByteTokens:
    """Read once a worker."""
    if (path, added) not in _known:
        _known[(path, added)] = ByteTokens(path, added)
    return _known[(path, added)]
