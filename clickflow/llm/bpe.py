"""Byte-level BPE through the ``tokenizers`` library, one segment at a time.

The library's pre-tokenizer never joins a character that is not white space
with white space that follows it, so a text may be cut at every such place
and each segment encoded on its own: the concatenation equals the library's
encoding of the whole text. Most texts are lines of words with one space
between them, so their segments are the line breaks, the first words of lines
and the other words with the space before them. Words repeat and are worth
remembering; white space of any other form takes a general path.
"""

from __future__ import annotations

import json
import re

#: Unicode White_Space, the library's ``\\s`` (fixed values).
WHITE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
_SEGMENT = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+")


class ByteBpe:
    """A byte-level BPE tokenizer file, checked to allow segment-wise encoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is supported")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that take neighbouring text along are not supported")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def split_special(self, text: str) -> list[str]:
        """Ordinary text and added tokens in turn (added tokens at odd places)."""
        if self.special is None or not any(name in text for name in self.added):
            return [text]
        return self.special.split(text)

    def pretokens(self, segment: str) -> list[str]:
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(segment)]

    def word_pretokens(self, word: str, space: str = "") -> list[str]:
        """Pre-tokens of a segment made of ``space`` (one or none) and a word that does not end in white space."""
        letters, point = (word[:-1], word[-1]) if word[-1] in POINTS else (word, "")
        if not letters.isalpha():
            return self.pretokens(space + word)
        if letters.isascii():
            letters = SPACE + letters if space else letters
        elif max(letters) < LATIN_END:  # letters on which all Unicode versions agree
            letters = _byte_chars(space + letters)
        else:
            return self.pretokens(space + word)
        return [letters, point] if point else [letters]

    def pretoken_ids(self, pretoken: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(pretoken)]

    def count_pieces(self, pretoken: str) -> int:
        return len(self.tok.model.tokenize(pretoken))


#: Characters from here on go to the library's own pre-tokenizer.
LATIN_END = "\u0250"
#: Single marks that end a word as a pre-token of their own.
POINTS = frozenset(".,;:!?")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's character for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


def _byte_chars(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_ALPHABET)


SPACE = _byte_chars(" ")
#: The pre-token of a line break between two lines that are not empty.
NEWLINE = _byte_chars("\n")


def plain_lines(text: str) -> list[list[str]] | None:
    """The words of each line, or None if a line is empty or has white space at its ends."""
    lines = [line.split(" ") for line in text.split("\n")]
    for words in lines:
        if not words[0] or words[0][0] in WHITE or splits_badly(words[-1]):
            return None
    return lines


def splits_badly(word: str) -> bool:
    """Whether the space after ``word`` continues white space, so that no cut is allowed there."""
    return not word or word[-1] in WHITE


def segments(text: str) -> list[str]:
    """The text cut wherever white space begins."""
    return _SEGMENT.findall(text)
