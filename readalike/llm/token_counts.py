"""Token counts by a finite-state transducer compiled from a BPE piece model.

Merging pieces pairwise by score gives, for every prefix of a text, one last piece, and a
piece may follow another exactly if the two stay apart when they are merged
alone. So the last pieces at the few places where a later piece can still begin are
all that the future depends on: these are the states. A transition reads one
character and is annotated with the tokens that it adds (this may be negative, as
characters join). States are compiled when a text first needs them.

No piece continues across a space, and a character that is in no piece becomes
byte tokens and separates its neighbours. At these places the transducer is in a known
state, so a text falls into chunks whose state maps are constant, and the
composition of such maps is the sum of their counts. A chunk's count is
found once for all its copies; the running sum over the chunks of a slice is the
prefix scan, and a text's count is the difference of two of its values.

Spaces become the mark U+2581, and one more stands in front of every text.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows with null or
repeated ids are counted each for itself; names of special tokens are plain text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalike.llm import text_arrays as ta
from readalike.llm.shipping import with_package

MARK = "▁"
LIMIT = 4096
KEPT_CHUNKS = 1_000_000    # chunks whose counts a worker remembers, then starts anew
KEPT_MOVES = 1_500_000     # likewise its compiled transitions

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Transducer:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as source:
            model.ParseFromString(source.read())
        rules = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or rules.name != "identity" or rules.remove_extra_whitespaces
                or not rules.add_dummy_prefix or not model.trainer_spec.byte_fallback):
            raise ValueError("the model isn't a BPE model of plain text with byte tokens")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.score):
            raise ValueError("a piece continues across a space")
        self.known = set("".join(self.score))
        self.heads = {p[:k] for p in self.score for k in range(1, len(p))}
        self.breaks = np.array([b < 128 and b != 0x20 and chr(b) not in self.known for b in range(256)])
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", ((0, None, 0),))
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.chunks: dict[int, int] = {}

    def trim(self) -> None:
        """Keeps what a worker remembers bounded; anything is found anew when needed."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        if len(self.moves) > KEPT_MOVES:
            self.reset()
        if len(self.apart) > KEPT_MOVES:
            self.apart.clear()
            self.whole.clear()

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours join, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: str | None, piece: str) -> bool:
        if last is None:
            if piece not in self.whole:
                self.whole[piece] = self.merged(piece) == [piece]
            return self.whole[piece]
        key = (last, piece)
        if key not in self.apart:
            self.apart[key] = self.merged(last + piece) == [last, piece]
        return self.apart[key]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """Next state and added tokens. A state lists the places where a piece may have begun:
        characters since, last piece before, tokens up to there less the tokens by now."""
        tail, places = self.states[state]
        if char not in self.known:
            move = (0, len(char.encode()))
        else:
            tail += char
            ends = [(tail[len(tail) - back - 1:], tokens) for back, last, tokens in places
                    if (back == 0 or tail[len(tail) - back - 1:] in self.score)
                    and self.may_follow(last, tail[len(tail) - back - 1:])]
            (piece, tokens), = ends
            added = tokens + (1 if piece in self.score else len(piece.encode()))
            kept = [(back + 1, last, before - added) for back, last, before in places
                    if tail[len(tail) - back - 1:] in self.heads]
            longest = max((back for back, _, _ in kept), default=0)
            new = (tail[len(tail) - longest:] if longest else "", (*kept, (0, piece, 0)))
            number = self.numbers.setdefault(new, len(self.states))
            if number == len(self.states):
                self.states.append(new)
            move = (number, added)
        self.moves[state, char] = move
        return move

    def count(self, chunk: str) -> int:
        state = total = 0
        moves = self.moves
        for char in chunk:
            state, added = moves.get((state, char)) or self.compile(state, char)
            total += added
        return total


@lru_cache(maxsize=2)
def transducer(model_file: str) -> Transducer:
    """One per worker process, shared by its tasks."""
    return Transducer(model_file)


@dataclass
class Chunks:
    """Chunks of a slice: the transducer is in its first state before each of them."""
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    opens: np.ndarray      # whether the chunk begins a text
    per_text: np.ndarray
    key: np.ndarray

    def raw(self, k: int) -> str:
        return self.data[self.starts[k]:self.stops[k]].tobytes().decode()

    def raws(self, which: np.ndarray) -> list[str]:
        """``raw`` of several chunks."""
        size = self.stops[which] - self.starts[which]
        edges = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(self.starts[which] - edges[:-1], size) + np.arange(edges[-1])
        found = pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(edges), pa.py_buffer(self.data[place]))
        return found.to_numpy(zero_copy_only=False).tolist()


def chunks_of(part: ta.Slice, breaks: np.ndarray) -> Chunks:
    """A chunk begins with a text, with a run of spaces, or after a byte of ``breaks``."""
    data, n = part.data, len(part.data)
    space = data == 0x20
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | breaks[data[:-1]]
    begin = part.begins[part.ends > part.begins]
    cut[begin] = True
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], n) if len(starts) else starts
    opens = np.zeros(n, bool)
    opens[begin] = True
    opens = opens[starts]
    code = ta.span_hashes(data, starts, stops)
    text = np.searchsorted(part.ends, starts, "right")
    return Chunks(data, starts, stops, opens, np.bincount(text, minlength=part.n),
                  np.where(opens, ~code, code))


def plain(texts: pa.Array) -> pa.Array:
    """Text with marks as spaces, which the model doesn't tell apart."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.replace_substring(texts, MARK, " ")


def counts(texts: pa.Array, machine: Transducer) -> np.ndarray:
    out = []
    for part in ta.slices(plain(texts)):
        chunks = chunks_of(part, machine.breaks)
        distinct, example, which = ta.distinct(chunks.key)
        machine.trim()
        known, tokens = machine.chunks, np.empty(len(distinct), np.int64)
        for k, key in enumerate(distinct.tolist()):
            value = known.get(key)
            if value is None:
                chunk = chunks.raw(example[k]).replace(" ", MARK)
                value = known[key] = machine.count(MARK + chunk if chunks.opens[example[k]] else chunk)
            tokens[k] = value
        scan = np.concatenate(([0], np.cumsum(tokens[which])))
        last = np.cumsum(chunks.per_text)
        out.append(scan[last] - scan[last - chunks.per_text])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """One row per document row. Every executor must have the model file at that path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            if batch.num_rows:
                text = batch.column("text")
                n = counts(text, machine)
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_bytes": size,
                    "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    narrow = with_package(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, COUNTS)
