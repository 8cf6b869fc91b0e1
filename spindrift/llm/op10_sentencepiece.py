"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model's own rule is byte pair merging, so a path through the lattice of pieces is scored by whether merging would
give it: a sequence of pieces is what merging gives exactly if each piece is what merging makes of its own characters,
and each neighbouring pair is what merging makes of the pair's. Each such pair scores 0, any other minus infinity.
A piece that ends at a place needs only the best path to where it starts, as in any Viterbi search; exactly one piece
survives at each place, and the backpointers from it are the tokens of the text so far.

Later pieces reach back at most the longest piece's length, so only the paths from that many last places matter. Every
LOOK places, whatever ends there, it is looked where their backpointers meet; the ids before that boundary are final and
leave the window. So a text of any length, without spaces or of unknown characters too, needs memory for its window of
some hundred places and its ids only. Words (see pieces.py) are cut where the paths always meet, and a task keeps the ids
of the short words it has seen in a cache bounded in bytes.

Pieces of spaces alone all have one score, the lowest, so merging leaves them to the end and takes them from the left. What
is in front of a word's own space is therefore cut into the longest such piece, as often as it fits, and what merging
makes of the rest; the vocabulary is checked for this rule when it is read (spaces).

Characters without a piece become their UTF-8 bytes' pieces. Decoding puts pieces together, spaces for `▁`, and takes
the first space off. Equal texts get equal ids, those of the library without added tokens. One row in, one row out, no
shuffle. Defined results: a null text counts as empty: no ids, and it reads back; a text with the character `▁` reads
back with spaces for it, so its round_trip is false; input columns named as outputs are replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append, table
from .op5_token_counts import model_path
from .pieces import BYTE, NORMAL, SPACE, Cache, Pieces, shown, words

#: Pairs of pieces whose verdict a task keeps; beyond, it starts anew. Only speed depends on it.
KEPT_PAIRS = 400_000
#: Places between two looks for a boundary on which all paths agree.
LOOK = 256

FIELDS = [
    T.StructField("n_pieces", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("round_trip", T.BooleanType()),
    T.StructField("decoded_sha256", T.StringType()),
]


class Lattice:
    """The pieces of a model with what the search needs to know of them."""

    def __init__(self, pieces: Pieces) -> None:
        proto = pieces.proto.pieces
        self.score = {p: proto[i].score for p, i in pieces.normal.items()}
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto) if p.type == BYTE}
        self.parts: dict[str, tuple[str, str]] = {}
        self.time: dict[str, tuple[float, int]] = {}
        self.ids = {}
        for p in sorted(pieces.normal, key=len):
            made = [p] if len(p) == 1 else self.merge(p, stop=True)
            if len(made) == 1:  # one character
                self.time[p] = (-1.0, 0)
            elif len(made) == 2 and made[0] in self.time and made[1] in self.time:
                self.parts[p] = (made[0], made[1])
                self.time[p] = max((-self.score[p], 0), self.time[made[0]], self.time[made[1]])
            else:  # merging never gives this piece
                continue
            self.ids[p] = pieces.normal[p]
        self.longest = max(map(len, self.ids))
        self.piece = {i: p for p, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()  # at each place, the pieces that end there, the longest first
        for p, i in self.ids.items():
            self.ends.add_word(p, (len(p), i))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.widest = 0  # places of the widest window so far
        runs = [p for p in self.score if set(p) == {SPACE}]
        self.run = max(map(len, runs))
        if self.run > 1 and ({self.score[p] for p in runs if len(p) > 1} != {min(self.score.values())} or any(p.startswith(SPACE * 2) and p not in runs for p in self.score)):
            raise ValueError("pieces of spaces do not merge last")
        self.rests = [[self.ids[p] for p in self.merge(SPACE * n)] for n in range(2 * self.run)]
        if any([self.ids[p] for p in self.merge(SPACE * n)] != self.spaces(n) for n in range(4 * self.run)):
            raise ValueError("runs of spaces are not cut alike")

    def merge(self, text: str, stop: bool = False) -> list[str]:
        """The parts that merging leaves of a text; with `stop`, the parts before the last merge if it would leave one."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-self.score[a + b], i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a + b in self.score]
        heapify(heap)
        left = len(part)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            if stop and left == 2:
                break
            part[i], part[j], after[i] = a + b, "", after[j]
            left -= 1
            if after[j] < len(part):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(part) and part[x] + part[y] in self.score:
                    heappush(heap, (-self.score[part[x] + part[y]], x, part[x], part[y]))
        return [p for p in part if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives a and b.

        Undo the merges at the border from the last one on: were the border's two parts mergeable, and earlier than the
        merge that took one of them, merging would have gone across.
        """
        score, time, parts = self.score, self.time, self.parts
        limit, in_left = (float("inf"), 0), True
        while True:
            across = score.get(a + b)
            if across is not None and ((-across, 0) < limit or not in_left and (-across, 0) == limit):
                return False
            ta, tb = time[a], time[b]
            if ta[0] < 0 and tb[0] < 0:
                return True
            if ta > tb:
                limit, in_left, a = ta, True, parts[a][1]
            else:
                limit, in_left, b = tb, False, parts[b][0]

    def spaces(self, n: int) -> list[int]:
        """The ids of n spaces that no word takes: the longest piece as often as it fits before a rest of at least its length."""
        whole = max(0, n // self.run - 1)
        return [self.ids[SPACE * self.run]] * whole + self.rests[n - whole * self.run]

    def encode(self, text: str) -> array:
        """The ids of a part of words() as shown(): `▁` stands at its start only, for its spaces."""
        front = len(text) - len(text.lstrip(SPACE))
        if front < 2:
            return self._search(text)
        ids = self._search(text[front - 1 :])
        if ids[0] == self.ids[SPACE]:  # the word has not taken its space
            return array("i", self.spaces(front)) + ids[1:]
        return array("i", self.spaces(front - 1)) + ids

    def _search(self, text: str) -> array:
        out = array("i")
        pairs, solved, base = self.pairs, 0, 0  # base: the window's first place
        survivor, size = [-1], [0]  # id (-1: none) and length of the surviving piece that ends at each place of the window
        looked = 0

        def settle() -> None:
            """Commit the ids before the boundary on which all paths agree."""
            nonlocal base, looked
            self.widest = max(self.widest, len(size))
            agreed = self._agreed(size, base, solved)
            self._path(text, survivor, size, base, agreed, out)
            del survivor[: agreed - base], size[: agreed - base]
            base, looked = agreed, solved

        def unknown(end: int) -> None:
            """Characters without a piece, up to `end`."""
            nonlocal solved
            while solved < end:
                n = min(LOOK, end - solved)
                survivor.extend([-1] * n)
                size.extend([1] * n)
                solved += n
                if solved - looked >= LOOK:
                    settle()

        for end, (n, i) in self.ends.iter(text):
            end += 1
            if end <= solved:
                continue
            if end - 1 > solved:
                unknown(end - 1)
            before = survivor[end - n - base]
            if before >= 0:
                key = before << 32 | i
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.fits(self.piece[before], self.piece[i])
                if not ok:
                    continue
            survivor.append(i)
            size.append(n)
            solved = end
            if end - looked >= LOOK:
                settle()
        unknown(len(text))
        self._path(text, survivor, size, base, len(text), out)
        return out

    def _agreed(self, size: list[int], base: int, end: int) -> int:
        """The boundary on which the paths from the last `longest` places, from where later pieces can start, agree."""
        live = set(range(max(base, end - self.longest + 1), end + 1))
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            live.add(max(base, i - size[i - base]))
        return live.pop()

    def _path(self, text: str, survivor: list[int], size: list[int], base: int, end: int, out: array) -> None:
        """Emit the ids on the path from the window's first place to `end`."""
        path = []
        while end > base:
            i = survivor[end - base]
            if i >= 0:
                path.append(i)
            else:
                path.extend(self.bytes_id[b] for b in reversed(text[end - 1].encode()))
            end -= size[end - base]
        path.reverse()
        out.extend(path)


class Codec:
    """Texts to ids and back."""

    def __init__(self, path: str) -> None:
        pieces = Pieces(path)
        lattice = Lattice(pieces)
        self.kept = Cache({}, lambda new: [lattice.encode(shown(w)).tobytes() for w in new])
        self.bytes = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in pieces.proto.pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        return list(map(b"".join, self.kept.look_up([words(t) for t in texts])))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_texts(df: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """df with n_pieces, ids, round_trip and decoded_sha256 (of the text read back from the ids) for its text column."""

    def make() -> Callable[[pa.Array], list]:
        codec = Codec(model or model_path())

        def run(texts: pa.Array) -> list:
            texts = [t or "" for t in texts.to_pylist()]
            ids = codec.encode(texts)
            sizes = [len(x) // 4 for x in ids]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            values = np.frombuffer(b"".join(ids), np.int32)
            back = [codec.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
            return [sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), [a == b for a, b in zip(texts, back, strict=True)], [hashlib.sha256(b.encode()).hexdigest() for b in back]]

        return run

    return append(df, [text_col], FIELDS, make, most=2 << 20)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of what they read back as."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
