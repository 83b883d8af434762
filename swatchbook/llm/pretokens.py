"""Cut a text into pieces that a byte-level BPE tokenizer encodes independently.

The pre-tokenizer of the byte-level vocabularies never joins characters across
the border in front of white space, so a text can be cut there and every
distinct piece needs to be encoded only once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

# Unicode's white space, and the pre-token pattern of the byte-level vocabularies.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)

# Anything but a single blank or line feed between two words.
_RUN = re.compile(rf"[{WHITE}]{{2,}}|(?![ \n])[{WHITE}]|\A[{WHITE}]|[{WHITE}]\Z")
_OTHER = re.compile(r"[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

# Pieces remembered per worker; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def _plain(text: str, spaced: bool, keys: list[str]) -> None:
    """Keys of a text in which words are set apart by one blank or line feed."""
    for n, line in enumerate(text.split("\n")):
        if n:
            keys.append(" \n")
        at = len(keys)
        keys.extend(line.split(" "))
        if n or not spaced:
            keys[at] = " " + keys[at]


def cut(text: str) -> list[str]:
    """Keys of a text's pieces in order.

    A key ``word`` stands for a blank and the word, a key that begins with a
    blank stands for what follows that blank. The pieces put together are the
    text; no piece is longer than a word, or a run of white space.
    """
    keys: list[str] = []
    if not (
        text[:1].isspace()
        or text[-1:].isspace()
        or any(pair in text for pair in ("  ", "\n\n", " \n", "\n "))
        or _OTHER.search(text)
    ):
        if text:
            _plain(text, False, keys)
        return keys
    start, spaced = 0, False
    for run in _RUN.finditer(text):
        if run.start() > start:
            _plain(text[start : run.start()], spaced, keys)
        white, spaced, start = run.group(), False, run.end()
        if start == len(text):
            keys.append(" " + white)
            return keys
        # The last character of a run belongs to the word behind it if it is
        # a blank, and is a token of its own otherwise.
        if len(white) > 1:
            keys.append(" " + white[:-1])
        if white[-1] == " ":
            spaced = True
        else:
            keys.append(" " + white[-1])
    if start < len(text):
        _plain(text[start:], spaced, keys)
    return keys


def literal(key: str) -> str:
    """The characters that a key stands for."""
    return key[1:] if key[:1] == " " else " " + key


def remember(memory: dict, keys: Sequence[list[str]], encode: Callable[[list[str]], Sequence]) -> None:
    """Add the pieces that ``memory`` lacks, encoded in one call."""
    if len(memory) > REMEMBERED:
        memory.clear()
    new = list(set().union(*keys).difference(memory)) if keys else []
    if new:
        memory.update(zip(new, encode([literal(k) for k in new]), strict=True))
