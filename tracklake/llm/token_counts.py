"""Token counts from a byte-pair vocabulary compiled, as texts ask for it, into a finite-state transducer.

A byte-pair encoding is fixed by its neighbours: a row of pieces is the encoding of its text if and only if every piece encodes to itself
and every two neighbours encode to themselves when joined. So what may still happen depends on little: the longest end of the text that
begins a piece, and for each place inside that end the last piece of the encoding up to there. This is a state. A transition reads one
character and is annotated with the number of tokens by which the encoding grows (it may shrink, as when a merge takes earlier pieces in).
States and transitions are made on first use, kept for the life of a Python worker and thrown away together when they become too many.

No piece has a word mark after another character, so a word's first mark always leads to the start state. That makes the map of a chunk small:
what stands before its first word start (the rest of a word that began earlier), the tokens counted from there on, and the state at its end.
Chunks of a text are mapped apart and the maps composed pairwise in rounds, as in a parallel prefix scan."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import sentencepiece
from pyspark.sql import DataFrame

from tracklake.llm.common import map_texts

MARK = "▁"
LIMIT, CHUNK, MOST_STATES = 4096, 65_536, 400_000  # a state takes some 600 bytes
WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")
PROBES = ("", " ", "a  b ", "ﬁ ①", "x\ny\t", "á é")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ranks, smaller ranks merging first; single characters that are no piece fall back to bytes."""

    name: str
    ranks: dict[str, float]

    @staticmethod
    def read(path: str) -> Vocabulary:
        """The vocabulary of a sentencepiece byte-pair model with byte fallback and without text normalisation (else ValueError)."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(MARK in piece.lstrip(MARK) for piece in ranks):
            raise ValueError("a piece goes on into the next word")
        made = Transducer(Vocabulary(path, ranks))
        if any(made.count(text) != len(model.encode(text)) for text in PROBES):
            raise ValueError("the model changes texts before it cuts them")
        return made.vocabulary


class State(dict):
    """Next states by character; a missing one is made by the transducer. ``gain`` is the annotation of the transitions that lead here."""

    __slots__ = ("gain", "end", "window", "owner")

    def __init__(self, owner, end, window, gain):
        super().__init__()
        self.owner, self.end, self.window, self.gain = owner, end, window, gain

    def __missing__(self, char):
        made = self[char] = self.owner.after(self, char)
        return made


@dataclass
class ChunkMap:
    """Tokens of a chunk as a function of what comes before it. ``head`` belongs to a word that began earlier; without a word start
    the chunk is all head. Else ``count`` tokens are begun after it and ``state`` is reached, whatever comes before."""

    head: str
    state: State | None
    count: int


class Transducer:
    def __init__(self, vocabulary: Vocabulary, most_states: int = MOST_STATES):
        self.vocabulary, self.most_states = vocabulary, most_states
        self.begins = {piece[:n] for piece in vocabulary.ranks if len(piece) > 1 for n in range(1, len(piece))}
        self.pairs: dict[tuple, bool] = {}
        self.edges: dict[str, tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs.clear()
        self.start = State(self, "", ((None, 0),), 0)

    def encode(self, text: str, formed: dict | None = None) -> list[str]:
        """Plain merging, best rank first and leftmost among equals, for short texts. ``formed`` takes the two parts of every merged piece."""
        parts, ranks = list(text), self.vocabulary.ranks
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return parts
            k = best[1]
            if formed is not None:
                formed[parts[k] + parts[k + 1]] = (parts[k], parts[k + 1])
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def _edges(self, piece: str) -> tuple | None:
        """The parts that stand at the left and at the right end of a piece while it forms, each with the ranks at which it comes and goes.
        None where the piece does not encode to itself or forms out of the order of ranks (runs of marks)."""
        if piece not in self.edges:
            formed: dict = {}
            whole = self.encode(piece, formed) == [piece]
            ranks, sides = self.vocabulary.ranks, []
            for side in (0, 1):
                part, gone, spine = piece, math.inf, []
                while True:
                    came = ranks[part] if len(part) > 1 else -math.inf
                    whole = whole and came < gone
                    spine.append((part, came, gone))
                    if len(part) == 1:
                        break
                    part, gone = formed[part][side], came
                sides.append(spine)
            self.edges[piece] = tuple(sides) if whole else None
        return self.edges[piece]

    def stand_together(self, first: str | None, then: str) -> bool:
        """Whether both pieces come out again when their joined text is encoded."""
        key = (first, then)
        if key not in self.pairs:
            left, right = self._edges(first) if first else None, self._edges(then)
            if not first or not left or not right:
                self.pairs[key] = self.encode((first or "") + then) == [p for p in key if p is not None]
            else:  # do two parts that meet at the border merge before either is gone? The left of two equal merges comes first.
                ranks = self.vocabulary.ranks
                self.pairs[key] = not any(max(ranks[a + b], came, comes) < gone and max(ranks[a + b], came, comes) <= goes
                                          for a, came, gone in left[1] for b, comes, goes in right[0] if a + b in ranks)
        return self.pairs[key]

    def after(self, state: State, char: str) -> State:
        if char not in self.vocabulary.ranks:  # bytes stand alone: nothing merges with them
            return self._state("", ((None, 0),), len(char.encode("utf-8", "surrogatepass")))
        if char == MARK and state is not self.start and not state.end.endswith(MARK):
            return self.start[char]
        text, window = state.end + char, state.window
        for begin in range(len(text)):  # window[begin]: last piece before text[begin:], and tokens up to there less those before char
            if window[begin] is None or text[begin:] not in self.vocabulary.ranks:
                continue
            last, tokens = window[begin]
            if self.stand_together(last, text[begin:]):
                break
        else:
            raise ValueError("the vocabulary has no encoding fixed by neighbours")
        gain = tokens + 1
        cut = next((k for k in range(len(text)) if text[k:] in self.begins), len(text))
        places = (*window, (text[begin:], gain))[cut:]
        return self._state(text[cut:], tuple((place[0], place[1] - gain) if place and (k == len(text) or text[k:] in self.begins) else None
                                             for k, place in enumerate(places, cut)), gain)

    def _state(self, end: str, window: tuple, gain: int) -> State:
        key = (end, window, gain)
        if key not in self.states:
            self.states[key] = State(self, end, window, gain)
        return self.states[key]

    def run(self, state: State, text: str) -> tuple[State, int]:
        tokens = 0
        for char in text:
            state = state[char]
            tokens += state.gain
        return state, tokens

    def map_chunk(self, chunk: str) -> ChunkMap:
        first = WORD_START.search(chunk)
        if not first:
            return ChunkMap(chunk, None, 0)
        return ChunkMap(chunk[:first.start()], *self.run(self.start, chunk[first.start():]))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.state is None:
            return self._opened(a.head + b.head, b)
        state, between = self.run(a.state, b.head)
        return ChunkMap(a.head, state if b.state is None else b.state, a.count + between + b.count)

    def _opened(self, head: str, b: ChunkMap) -> ChunkMap:
        """``b`` with a longer head, in which a word may now be seen to start (a mark at a chunk's first place)."""
        first = WORD_START.search(head)
        if not first:
            return ChunkMap(head, b.state, b.count)
        state, tokens = self.run(self.start, head[first.start():])
        return ChunkMap(head[:first.start()], state if b.state is None else b.state, tokens + b.count)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if len(self.states) > self.most_states:
            self.forget()
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.map_chunk(text[k:k + chunk]) for k in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.run(self.start, maps[0].head)[1] + maps[0].count


_COMPILED: dict[str, Transducer] = {}  # one per vocabulary and Python worker


def counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    if vocabulary.name not in _COMPILED:
        _COMPILED[vocabulary.name] = Transducer(vocabulary)
    return _COMPILED[vocabulary.name].count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, for the model at ``path``.

    The file is read on the driver and its pieces (32,000 strings) are broadcast, so executors need no file. Whole texts are counted; null and
    empty texts have no bytes and no tokens. Rows that repeat an id, or have none, are counted each; further columns are not read. Without
    begin, end or added special tokens; the spelling of a special token inside a text is ordinary text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def measure(text: str) -> tuple[int, int, bool]:
        tokens = counter(shared.value)(text)
        return len(text.encode("utf-8", "surrogatepass")), tokens, tokens > limit

    return map_texts(docs, measure, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
