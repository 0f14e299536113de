"""Token ids of whole texts, as the `tokenizers` library gives them.

Two quick ways stand beside the library, each used only where it gives the library's ids:

* ByteBpe: the byte-level vocabulary also exists as ranks. For texts whose characters all lie below
  U+0250 and that hold no special string, the rank encoder splits and merges alike (the tests compare
  every such character in context); any other text goes to the library itself.
* WordBpe: this vocabulary encodes words one by one, so each new word is encoded once, by the same merges
  written as ranks (a trailing blank stands for the word end), and a bounded memo of words gives the rest.
  Texts with characters from U+0250 on, before or after lower-casing, or with special strings go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Below U+0250 the Unicode tables of both encoders agree.
PLAIN_LIMIT = 0x250
_NOT_PLAIN = re.compile(r"[^\x00-ɏ]")
#: Words the memo of a worker holds before it starts anew.
MEMO_WORDS = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class ByteBpe:
    """Ids of the byte-level vocabulary; special strings in texts become their ids, the library's default."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        self.tok = _library(json_path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special_ids = sorted(self.tok.get_added_tokens_decoder())
        if ranks_path is None and os.path.exists(json_path.removesuffix(".json") + ".tiktoken"):
            ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        self.ranks = None
        lengths = np.zeros(self.tok.get_vocab_size(), np.int64)
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            for token, i in ranks.items():
                lengths[i] = len(token)
        else:
            for token, i in self.tok.get_vocab().items():
                lengths[i] = len(token)  # one character of the byte alphabet for each byte
        for i, t in self.tok.get_added_tokens_decoder().items():
            lengths[i] = len(t.content.encode())
        #: UTF-8 bytes that each id stands for.
        self.lengths = lengths

    def plain(self, text: str) -> bool:
        return self.ranks is not None and not any(s in text for s in self.specials) and (text.isascii() or _NOT_PLAIN.search(text) is None)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.plain(text):
            return np.array(self.ranks.encode_ordinary(text), np.uint32)
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def count(self, text: str) -> int:
        if self.plain(text):
            return len(self.ranks.encode_ordinary(text))
        return len(self.ids(text))


#: The word pattern over lower-cased characters below U+0250; letters and digits are those classes of Unicode.
def _plain_word_pattern() -> re.Pattern:
    import unicodedata

    def ranges(kind: str) -> str:
        found = [c for c in range(PLAIN_LIMIT) if unicodedata.category(chr(c)).startswith(kind)]
        out, start = [], None
        for c in found:
            if start is None or c != last + 1:  # noqa: F821
                if start is not None:
                    out.append((start, last))  # noqa: F821
                start = c
            last = c
        out.append((start, last))
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    letters, digits = ranges("L"), ranges("N")
    space = r"\u0009-\u000d \u0085 "
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{space}{letters}{digits}]+")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _word_ranks(json_path: str):
    """The merges as ranks of byte strings, a blank at the end for the word end; and the id of each rank."""
    import json

    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = _byte_alphabet(), model["vocab"]

    def raw(token: str) -> bytes:
        body, end = (token.removesuffix("</w>"), b" ") if token.endswith("</w>") else (token, b"")
        return bytes(alphabet[c] for c in body) + end

    order: dict[bytes, int] = {}
    for c, b in alphabet.items():
        order.setdefault(bytes([b]), vocab[c])
    for c, b in alphabet.items():
        order.setdefault(bytes([b]) + b" ", vocab[c + "</w>"])
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        order.setdefault(raw(left + right), vocab[left + right])
    ranks = {token: k for k, token in enumerate(order)}
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), np.array(list(order.values()), np.uint32)


class WordBpe:
    """Ids of the vocabulary with word ends; `bytes_of` gives them as little-endian unsigned 32-bit integers."""

    def __init__(self, json_path: str, memo_words: int = MEMO_WORDS):
        self.tok = _library(json_path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks, self.id_of = _word_ranks(json_path)
        self.ends = np.zeros(len(self.id_of), bool)
        for token, i in self.ranks._mergeable_ranks.items():
            self.ends[i] = token.endswith(b" ")
        self.findall = _plain_word_pattern().findall
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _learn(self, words: list[str]) -> None:
        """Encodes new words in one call: between blanks each is a word of its own, and only its last id ends a word."""
        ranks = np.array(self.ranks.encode_ordinary(" ".join(words) + " "), np.uint32)
        stops = np.flatnonzero(self.ends[ranks]) + 1
        raw, memo, at = self.id_of[ranks].astype("<u4").tobytes(), self.memo, 0
        for word, stop in zip(words, (stops * 4).tolist(), strict=True):
            memo[word] = raw[at:stop]
            at = stop

    def bytes_of(self, text: str) -> bytes:
        if not text:
            return b""
        low = text.lower()
        if (not text.isascii() and (_NOT_PLAIN.search(text) or _NOT_PLAIN.search(low))) or any(s in text for s in self.specials):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, memo = self.findall(low), self.memo
        if new := {w for w in words if w not in memo}:
            if len(memo) + len(new) > self.memo_words:
                memo.clear()
                new = set(words)
            self._learn(list(new))
        return b"".join(map(memo.__getitem__, words))


_LOADED: dict = {}


def loaded(kind: type, path: str):
    """One encoder for each Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
