"""Token ids of the public byte-level vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

CACHE_WORDS = 400_000
_OTHER_SPACE = re.compile(r"[^\S \n]")


def plain_spaces(text: str) -> bool:
    """Whether all white space is single spaces or line feeds between other characters."""
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as little-endian 16-bit bytes. Words between single spaces are encoded once and kept.

    A single space between two other characters always begins a new pre-token of this vocabulary,
    so a text whose white space is only single spaces and line feeds equals the concatenation of
    its words, each with its leading space. Other texts are encoded in one piece. The cache is a
    bounded speed-up without effect on results.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding(
            "corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={"<|endoftext|>": len(ranks)})
        self.known: dict[str, bytes] = {}
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def whole(self, text: str) -> bytes:
        if "<|" in text:
            return np.array(self.core.encode(text, allowed_special="all"), "<u2").tobytes()
        return np.array(self.core.encode_ordinary(text), "<u2").tobytes()

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each word with its leading space; only the first id of a word has the space."""
        raw = self.whole(" " + " ".join(words))
        cuts = (2 * np.flatnonzero(self.opens[np.frombuffer(raw, "<u2")])).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:] + [len(raw)])]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not plain_spaces(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.known
        parts = list(map(known.get, rest))
        if None in parts:
            missing = [k for k, p in enumerate(parts) if p is None]
            new = [rest[k] for k in missing]
            for k, word, ids in zip(missing, new, self._each(new)):
                parts[k] = ids
                if len(known) < CACHE_WORDS and len(word) < 40:
                    known[word] = ids
        return self.whole(first) + b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
