"""Token ids from public vocabulary files; the file's path is always a parameter."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

CACHE = 300_000
_ODD = "\x1c\x1d\x1e\x1f"  # white space to Python's split, symbols to the tokenizer


class WordTokenizer:
    """A tokenizer that drops white space, run word by word over a bounded cache.

    Its normaliser and splitter treat text between white space on its own, so the
    ids of a text are those of its words in order. At most CACHE words are held
    (none of over 48 characters); a full cache is emptied.

    Words outside the cache of plain characters (visible ASCII, the letters of
    Latin-1) are split here and merged by tiktoken on the same vocabulary: a pair
    merges there if its concatenation is a token, which is the same rule as long
    as every token is what its own characters merge to (a test checks that for the
    vocabulary). A byte that UTF-8 never holds stands for the end of a word. All
    other words go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in w.removesuffix("</w>")) + b"\xff" * w.endswith("</w>"): i for w, i in vocabulary.items() if w not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks | {b"\xff": ranks[b"\xff"]}, special_tokens={})._core_bpe.encode_single_piece
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def _ids(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            merge, out = self.merge, []
            for x in self.parts(word.lower()):
                out += merge(x.encode() + b"\xff")
        else:
            out = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in _ODD):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, extra = self.cache, {}
        for w in set(words).difference(cache):
            (cache if len(w) <= 48 else extra)[w] = self._ids(w)
        if extra:
            return b"".join([cache[w] if w in cache else extra[w] for w in words])
        return b"".join(map(cache.__getitem__, words))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str):
    """A byte-level encoding from a file of ranks; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
