"""Tokenizers by file, one copy per Python process, and fast exact paths around them.

Texts made only of characters whose classes every Unicode version agrees on (SAFE) take a fast path; all others
go through the library named for the vocabulary, so results are the library's own on any text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np

#: Tab, line ends, printable ASCII and Latin letters and signs, without the superscript and fraction digits:
#: stable under NFC, and their letter, digit and space classes are the same in all engines used here.
SAFE = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ]*")


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoding without special tokens from a rank file, and its table of token bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = {v: k for k, v in ranks.items()}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(maxsize=4)
def pattern_of(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def greatest_id(path: str) -> int:
    """The greatest id of a .json vocabulary, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte, built by their published rule."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def byte_level_encoder(path: str):
    """``encode(text) -> uint32 array`` equal to the tokenizers library's ids for a byte-level .json vocabulary.

    Safe texts without special strings go through the same merges as ranks; other texts through the library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    ranks = {bytes(letter[c] for c in k): v for k, v in vocab.items()}
    fast = tiktoken.Encoding("same merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = library_tokenizer(path)
    specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))

    def encode(text: str) -> np.ndarray:
        if (text.isascii() or SAFE.fullmatch(text)) and not specials.search(text) and (not text.isascii() or SAFE.fullmatch(text)):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


#: Ends a word in the rank form of a word-end vocabulary; no word of SAFE characters holds it.
END = "\0"


class WordPieces:
    """A lower-casing word-end BPE vocabulary (.json).

    ``words(text)`` gives the text's pre-tokens and its number of special tokens, ``counts(words)`` the number of ids of
    each, ``encode(text)`` all ids of a text as little-endian unsigned 32-bit bytes.

    Words of SAFE characters are encoded through ranks: a word is written with an end mark, a token that ends a word
    too, the marked single bytes come first among the merges and the others follow in the vocabulary's order. Whether
    that gives the library's ids is checked on a spread of the vocabulary's own words when it is loaded; if not, all
    goes through the library.
    """

    CHECKED_WORDS = 2000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.letter = {c: b for b, c in byte_letters().items()}
        # The vocabulary's own split pattern for lowered characters of SAFE, with their letters listed.
        self.safe_words = re.compile(r"[a-zªµºß-öø-ɏ]+|'(?:[stmd]|re|ve|ll)|[0-9]|(?:[^\s\w]|_)+").findall
        self.ranks, self.to_id, self.ends = self._rank_form({k: v for k, v in spec["model"]["vocab"].items() if k not in special}, spec["model"]["end_of_word_suffix"])
        known = [k.removesuffix(spec["model"]["end_of_word_suffix"]) for k in list(spec["model"]["vocab"])[:: max(1, len(spec["model"]["vocab"]) // self.CHECKED_WORDS)]]
        known = [k for k in known if k.isascii() and k not in special]
        if [x for ids in self._library_ids(known) for x in ids] != self._rank_ids(known).tolist():
            self.ranks = None
        del self.model  # large, and wanted again only for words outside SAFE

    @cached_property
    def model(self):
        """The vocabulary's model alone, for single words."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        bare = {"added_tokens": [], "normalizer": None, "post_processor": None, "truncation": None, "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        return Tokenizer.from_str(json.dumps(spec | bare))

    @property
    def library(self):
        return library_tokenizer(self.path)

    def _rank_form(self, vocab: dict[str, int], suffix: str):
        import tiktoken

        mark = END.encode()
        tokens = sorted((v, bytes(self.letter[c] for c in k.removesuffix(suffix)) + mark * k.endswith(suffix)) for k, v in vocab.items())
        of_byte = {t[0]: v for v, t in tokens if len(t) == 1}
        marked = [(v, t) for v, t in tokens if len(t) == 2 and t.endswith(mark)]
        longer = [(v, t) for v, t in tokens if len(t) > 1 and not (len(t) == 2 and t.endswith(mark))]
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, (_, t) in enumerate([*marked, *longer])}
        to_id = np.array([of_byte.get(b, 0) for b in range(256)] + [v for v, _ in [*marked, *longer]], dtype="<u4")
        ends = np.zeros(len(to_id), dtype=bool)
        ends[[r for t, r in ranks.items() if t.endswith(mark)]] = True
        return tiktoken.Encoding("word ends", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}), to_id, ends

    def _rank_numbers(self, words: list[str]) -> np.ndarray:
        return self.ranks.encode_to_numpy(END.join(words) + END, disallowed_special=()) if words else np.empty(0, dtype=np.uint32)

    def _rank_ids(self, words: list[str]) -> np.ndarray:
        return self.to_id[self._rank_numbers(words)]

    def _library_ids(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def is_fast(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not self.special.search(text)

    def words(self, text: str) -> tuple[list[str], int]:
        if self.is_fast(text):
            return self.safe_words(text.lower()), 0
        found: list[str] = []
        parts = self.special.split(text)
        for part in parts:
            if part:
                normal = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    found.append(bytes(self.letter[c] for c in piece).decode())
        return found, len(parts) - 1

    def counts(self, words: list[str]) -> list[int]:
        plain = [w for w in words if SAFE.fullmatch(w)] if self.ranks else []
        n = dict(zip(plain, np.diff(np.flatnonzero(self.ends[self._rank_numbers(plain)]), prepend=-1).tolist(), strict=True))
        others = [w for w in words if w not in n]
        n |= dict(zip(others, map(len, self._library_ids(others)), strict=True))
        return [n[w] for w in words]

    def encode(self, text: str) -> bytes:
        if self.ranks and self.is_fast(text):
            return self._rank_ids(self.safe_words(text.lower())).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
