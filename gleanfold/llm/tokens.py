"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import os
import re

END_ID = 1
#: Space characters that str.split() takes and the tokenizer's \s doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: A run of Latin letters, then a run of ASCII symbols other than the apostrophe.
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes; encodes on a miss.

    A run of Latin letters is a unit of its own to this tokenizer, in lower case, and so is what
    punctuation follows it. Such units go straight to its BPE model; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin letters in the library's byte-level alphabet
        letters = {x for c in range(0x250) for x in chr(c).lower() if x.isalpha()}
        self.letters = {ord(x): split.pre_tokenize_str(x)[0][0] for x in letters}

    def __missing__(self, word: str) -> bytes:
        m = _LATIN(word)
        low = m[1].lower() if m else ""
        if m is None or len(low) != m.end(1):
            out = self.whole(word)
        else:
            out = self.get(low)
            if out is None:
                four = self.four
                out = self[low] = b"".join([four[t.id] for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))])
            if m[2]:
                out += self[m[2]]
        self[word] = out
        return out

    def whole(self, word: str) -> bytes:
        return b"".join([self.four[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])


def _plain(text: str) -> bool:
    """Whether lower-casing at once is what the tokenizer does by itself: Latin-1 letters, and nothing like a special token."""
    if "<|" in text:
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class TextEncoder:
    """Encodes texts word by word. Valid for a tokenizer that drops white space and never looks across it.

    Memory: at most ``cap`` words are kept; beyond it the cache starts anew between two texts.
    """

    def __init__(self, path: str, cap: int = 400_000):
        self.cache, self.cap = WordCache(path), cap

    def __call__(self, text: str | None) -> bytes:
        """All ids of the text and the end id, as little-endian unsigned 32-bit bytes."""
        if len(self.cache) > self.cap:
            self.cache.clear()
        text = text or ""
        words = [text] if _ODD.search(text) else (text.lower() if _plain(text) else text).split()
        return b"".join(map(self.cache.__getitem__, words)) + END_ID.to_bytes(4, "little")

    @property
    def vocab_size(self) -> int:
        return self.cache.tokenizer.get_vocab_size()


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This process's encoder: a Python worker keeps its word cache from task to task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
