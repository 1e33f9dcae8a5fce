"""Tokens of a lower-casing word vocabulary, with a cache of words.

Texts repeat their words, so most of a text is looked up: it is normalised and
split as the vocabulary's own rules say, and only words not met before go
through the tokenizer. The rules are applied here only to texts of plain Latin
characters, for which they are stated below; any other text is given to the
tokenizer whole.
"""

import json
import os
import re

import numpy as np

#: Characters for which lower-casing, composition and the
#: split below do what the tokenizer's normaliser and splitter do.
PLAIN = re.compile("[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž–—‘-„…¡§«»¿]*")
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿā-ž]+|\d|[^\sa-zß-öø-ÿā-ž0-9]+")

#: Words kept by one task's worker.
CACHE_WORDS = 400_000

_loaded: dict[str, "WordTokens"] = {}


#: Stands for the end of a word; this byte is never part of UTF-8.
WORD_END = b"\xff"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _merger(path: str):
    """A function from a word's bytes to its ids, or None.

    The vocabulary's own merges, run by tiktoken, for which ids in merge order
    are ranks. That gives the same ids if each token's own spelling is merged
    into just that token, which is tried for the whole vocabulary.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("end_of_word_suffix") != "</w>" or model["type"] != "BPE":
        return None
    byte, ranks = _byte_of(), {}
    for token, rank in model["vocab"].items():
        ends = len(token) > 4 and token.endswith("</w>")
        letters = token[:-4] if ends else token
        if not all(c in byte for c in letters):
            return None
        ranks[bytes(byte[c] for c in letters) + WORD_END * ends] = rank
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(model["vocab"]) - len(pairs)
    if len(ranks) != len(model["vocab"]) or any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return merge if all(merge(spelling) == [rank] for spelling, rank in ranks.items()) else None


class WordTokens(dict):
    """Maps a word to its ids, packed as little-endian unsigned 32-bit."""

    @classmethod
    def load(cls, path: str) -> "WordTokens":
        """One per worker process and file."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.merge = _merger(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.merge(word.encode() + WORD_END), "<u4").tobytes() if self.merge else self.whole(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def packed(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not PLAIN.fullmatch(text) or "<" in text and self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))
