"""A SentencePiece BPE vocabulary: where texts can be cut without changing their tokens, and what a task keeps of words.

In this kind of model two neighbouring parts merge only if their concatenation is a piece. So where no piece holds two
characters side by side, nothing ever merges across them: the text can be cut there and the parts encoded alone. The
vocabulary is checked for two such places: before a `▁` (a space) that follows something else, and on both sides of a
line break. `words()` cuts there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

SPACE = "▁"
#: Bytes, about, of the words that a task keeps besides those of the vocabulary; beyond, it starts anew. Longer words than
#: LONG characters, such as paragraphs of scripts without spaces, are not kept. Only speed depends on either.
KEPT_BYTES = 160 << 20
LONG = 64

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """The model file, read once in each task."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            self.proto = model_pb2.ModelProto.FromString(f.read())
        norm, kinds = self.proto.normalizer_spec, {p.type for p in self.proto.pieces}
        if self.proto.trainer_spec.model_type != 2 or not self.proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("the model normalises texts or has pieces of its user; words cannot be cut ahead of it")
        self.normal = {p.piece: i for i, p in enumerate(self.proto.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.normal):
            raise ValueError("a piece spans a word's border")

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def alone(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of words() parts (but the empty one), each encoded alone.

        The library puts a `▁` before every text, which stands for the one that a part has or is short for; before a
        line break there is none, so its token is taken off.
        """
        ids = self.library.encode([p[1:] if p[0] in _MARKS else p for p in parts], num_threads=1)
        return [x[1:] if p[0] == "\n" else x for p, x in zip(parts, ids, strict=True)]


_MARKS = SPACE + "\n"
_RUNS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def words(text: str) -> list[str]:
    """The parts of a text, in order; what they stand for, joined, is `▁` and the text with `▁` for each space.

    `word` stands for `▁word` and the empty part for a `▁` alone; a doubled line break for one line break, with the word
    that follows it without a space; a part that starts with two or more `▁` for itself.
    """
    if not text:
        return []
    if SPACE not in text:
        parts = text.replace("\n", " \n\n").split(" ")
        if "" not in parts:
            return parts
    parts = []
    for run in _RUNS.findall(SPACE + text.replace(" ", SPACE)):
        if run == "\n":
            parts.append("\n\n")
        elif run[0] != SPACE:
            parts[-1] += run
        else:
            parts.append(run if run.startswith(SPACE * 2) else run[1:])
    return parts


def shown(part: str) -> str:
    """What a part of words() stands for."""
    return part[1:] if part.startswith("\n") else part if part.startswith(SPACE) else SPACE + part


class Cache:
    """What is known of words: base for good, others up to KEPT_BYTES and then anew."""

    def __init__(self, base: dict, encode: Callable[[list[str]], Iterable]) -> None:
        self.base, self.encode, self.kept, self.held = base, encode, dict(base), 0

    def look_up(self, parts: list[list[str]]) -> list[list]:
        """The value of each part of each list; what is not kept yet is encoded once for all lists."""
        if self.held > KEPT_BYTES:
            self.kept, self.held = dict(self.base), 0
        found = [list(map(self.kept.get, p)) for p in parts]
        short = [(p, f) for p, f in zip(parts, found, strict=True) if None in f]
        new = list({w for p, f in short for w, x in zip(p, f, strict=True) if x is None})
        made = dict(zip(new, self.encode(new), strict=True))
        kept = {w: x for w, x in made.items() if len(w) <= LONG}
        self.kept.update(kept)
        self.held += sum(160 + 4 * len(w) for w in kept)  # two objects and their place in the table
        for p, f in short:
            f[:] = [made[w] if x is None else x for w, x in zip(p, f, strict=True)]
        return found
