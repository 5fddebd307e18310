"""Token counts from a tokenizer compiled to finite-state transducers.

Two deterministic transducers run one behind the other.

Splitter: eight states over nine symbols say before which characters a piece begins. A chunk of text
maps each of the eight states to a state; the maps of all chunks compose through a parallel prefix
scan, and then every chunk is run once from the state in which it really starts.

Counter: over a piece's bytes; each transition is annotated with the number of tokens by which the
count of the longer prefix exceeds that of the shorter one, so the annotations along a piece add up
to its token count. A state is what decides all that can follow: the longest suffix that begins some
token, and for each of its positions the last token of the encoding up to there and the count
relative to the present one. The next last token is the one that ends here and may follow the last
token where it begins; two tokens may follow each other if merging their joined bytes gives them
back. States and transitions are compiled when first met; at MAX_STATES states or ARCS_A_STATE times as many arcs the tables
start anew with the state that is live, in the middle of a piece too, so a piece of any length takes no more.
Counts of frequent pieces are kept in a memo of bounded size.

Counts equal those of byte-level BPE vocabularies in the JSON format with the usual English
contraction and category split, where no special token is added and special strings in a text count
as themselves if the tokenizer is told so, else as one token.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens; texts of any length are counted whole, also
one without any white space; repeated rows count alike; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._rows import map_texts

MAX_STATES = 100_000
#: Arcs at which they start anew too, for each of so many states.
ARCS_A_STATE = 3
MAX_PIECES = 300_000
#: Bytes of a piece that is remembered, at most.
MEMO_BYTES = 64
#: Characters of a chunk of the splitter.
CHUNK = 256

# Splitter symbols: letter, number, other, apostrophe that begins a contraction of 2 or of 3
# characters, white space that more white space or the end follows, last space of a run, other last
# white space of a run, end of text.
LETTER, NUMBER, OTHER, SHORT, LONG, WHITE, LAST_SPACE, LAST_WHITE, END = range(9)
# Splitter states: a piece has ended; within letters, numbers, others, white space; after a space that
# begins a piece; one or two characters of a contraction to come.
DONE, LETTERS, NUMBERS, OTHERS, WHITES, SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    following, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for s in range(8):
        for symbol, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            following[symbol, s], begins[symbol, s] = own, s not in (own, SPACE)
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            joins = s in (OTHERS, SPACE)
            following[symbol, s], begins[symbol, s] = OTHERS if joins else left, not joins
        following[WHITE, s], begins[WHITE, s] = WHITES, s != WHITES
        following[LAST_SPACE, s], following[LAST_WHITE, s], following[END, s] = SPACE, DONE, DONE
    following[LETTER, ONE_LEFT], begins[LETTER, ONE_LEFT] = DONE, False
    following[LETTER, TWO_LEFT], begins[LETTER, TWO_LEFT] = ONE_LEFT, False
    begins[END, :] = False
    return following, begins


@lru_cache(1)
def _categories() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    table[0x1C:0x20] = OTHER  # separators that only some libraries take for white space
    return table


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _splitter()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Splitter symbols of characters; ends marks the positions of END."""
    kinds = _categories()[points]
    kinds[ends] = END
    white = kinds == WHITE
    stays = np.append(white[1:] | (kinds[1:] == END), True)
    kinds[white & ~stays] = LAST_WHITE
    kinds[white & ~stays & (points == 0x20)] = LAST_SPACE
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate((points, [0, 0]))
        a, b = padded[at + 1], padded[at + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kinds[at[short]], kinds[at[long]] = SHORT, LONG
        kinds[ends] = END
    return kinds


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Which characters begin a piece, given that the first is met in state DONE."""
    following, begins = _tables()
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    # each chunk's map of all states
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    flat = following.reshape(-1)
    for step in steps:
        maps = flat[(step.astype(np.uint16) << 3)[:, None] | maps]
    # prefix scan: maps[i] becomes the map of chunks 0 to i
    shift = 1
    while shift < rows:
        maps = np.concatenate((maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)))
        shift *= 2
    state = np.concatenate(([DONE], maps[:-1, DONE])).astype(np.uint8)
    found, flags = np.empty((CHUNK, rows), bool), begins.reshape(-1)
    for i, step in enumerate(steps):
        at = (step.astype(np.uint16) << 3) | state
        found[i] = flags[at]
        state = flat[at]
    return found.T.reshape(-1)[:n]


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Counter over bytes, compiled as it is met."""

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.halves = {t: pair for t in vocabulary if len(t) > 1 and (pair := self._last_pair(t))}
        self.tokens = self.halves.keys() | {t for t in vocabulary if len(t) == 1}
        self.open = {t[:i] for t in self.tokens for i in range(1, len(t))}  # what a longer token begins with
        self.longest = max(map(len, self.tokens))
        self.right = {t: self._edge(t, 1) for t in self.tokens}
        self.left = {t: self._edge(t, 0) for t in self.tokens}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states = [(b"", (None,), (0,))]  # live suffix; last token and relative count at its positions
        self.index = {self.states[0]: 0}
        self.arcs: dict[int, int] = {}  # state and byte -> next state and emitted count

    def _merges(self, raw: bytes):
        """Byte-pair merges by rank, as the definition has it: the parts after each round."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            yield parts
            best = min(zip(parts, parts[1:]), key=lambda p: self.ranks.get(p, 1 << 60), default=None)
            if best not in self.ranks:
                return
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged

    def _last_pair(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of which merging makes a token; None if it never makes it."""
        before = None
        for parts in self._merges(token):
            if len(parts) == 1:
                return before
            before = (parts[0], parts[1]) if len(parts) == 2 else None
        return None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at an edge of a token while it is merged, and the rank that ends each."""
        found, ends = [], 1 << 60
        while True:
            found.append((token, ends))
            if len(token) == 1:
                return found
            ends = self.ranks[self.halves[token]]
            token = self.halves[token][side]

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether merging a and b joined leaves both: no merge across the border comes while both its parts stand.

        Of merges of equal rank the leftmost comes first, so a part on the right may end at that rank.
        """
        if a is None:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            rank, left = self.ranks.get, self.left[b]
            known = True
            for x, x_ends in self.right[a]:
                for y, y_ends in left:
                    r = rank((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
            self.fits[a, b] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The arc that leaves state with byte: next state in the high bits, emitted count plus 32768 in the low 16."""
        live, last, counts = self.states[state]
        grown = live + bytes((byte,))
        tokens = self.tokens
        for size in range(min(len(grown), self.longest), 0, -1):
            token = grown[-size:]
            if token in tokens and counts[-size] is not None and self.follows(last[-size], token):
                break
        emitted = counts[-size] + 1
        # positions that no longer token can begin at are forgotten, so that states which differ there are one
        alive = [size for size in range(min(len(grown), self.longest), 0, -1) if grown[-size:] in self.open]
        keep = alive[0] if alive else 0
        lasts, relative = [None] * keep, [None] * keep
        for size in alive:
            lasts[keep - size], relative[keep - size] = last[-size], counts[-size] - emitted
        made = (grown[len(grown) - keep :], (*lasts, token), (*relative, 0))
        target = self.index.get(made)
        if target is None:
            target = self.index[made] = len(self.states)
            self.states.append(made)
        arc = self.arcs[state << 8 | byte] = target << 16 | (emitted + 32768)
        return arc

    def _full(self) -> bool:
        return len(self.states) >= MAX_STATES or len(self.arcs) >= ARCS_A_STATE * MAX_STATES

    def _restarted(self, state: int) -> int:
        """The number of a live state in tables that start anew with it."""
        live = self.states[state]
        self._clear()
        number = self.index.setdefault(live, len(self.states))
        if number == len(self.states):
            self.states.append(live)
        return number

    def run(self, piece: bytes) -> int:
        """Tokens of a piece: the sum of what its transitions emit. Full tables start anew, within a piece too."""
        arcs, state, total = self.arcs, 0, 0
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if self._full():
                    state = self._restarted(state)
                    arcs = self.arcs
                arc = self._compile(state, byte)
            state = arc >> 16
            total += (arc & 65535) - 32768
        return total

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MAX_PIECES:
            memo.clear()
        found = list(map(memo.get, pieces))
        if None in found:
            run = self.run
            for i, n in enumerate(found):
                if n is None:
                    piece = pieces[i]
                    n = memo.get(piece)
                    if n is None:
                        n = run(piece)
                        if len(piece) <= MEMO_BYTES:
                            memo[piece] = n
                    found[i] = n
        return np.array(found, np.int64)


class TokenCounter:
    """Counts tokens of texts under a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        alphabet = _byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        vocabulary = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in set(self.special)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.counter = CountTransducer(vocabulary, {(raw(a), raw(b)): i for i, (a, b) in reversed([*enumerate(merges)])})
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        parts, whose, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.find_special is not None and self.find_special.search(t):
                cut = self.find_special.split(t)
                extra[i] = len(cut) - 1
                for c in cut:
                    if c:
                        parts.append(c)
                        whose.append(i)
            else:
                parts.append(t)
                whose.append(i)
        if not parts:
            return extra
        joined = "\x00".join(parts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths) - 1
        begins = piece_starts(symbols(points, ends))
        begins[ends] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        at = np.flatnonzero(begins)
        cuts = place[at].tolist()
        raw = joined.encode()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        counts = np.append(self.counter.counts(pieces), 0)
        counts[np.searchsorted(at, ends)] = 0
        owner = np.searchsorted(ends, at)
        return extra + np.bincount(np.array(whose)[owner], weights=counts, minlength=len(texts)).astype(np.int64)


_compiled: dict[str, TokenCounter] = {}


def compiled(spec: str) -> TokenCounter:
    """One compiled counter a worker process."""
    if spec not in _compiled:
        _compiled.clear()
        _compiled[spec] = TokenCounter(spec)
    return _compiled[spec]


def count_tokens(docs: DataFrame, keep: list[str], tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """The kept columns with n_bytes (UTF-8) and n_tokens of each whole text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        counter = compiled(spec.value)

        def count(texts: pa.Array) -> dict:
            sizes = pa.compute.binary_length(texts.cast(pa.binary())).fill_null(0)
            return {"n_bytes": sizes.cast(pa.int64()), "n_tokens": counter(texts.to_pylist())}

        return count

    return map_texts(docs, keep, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], factory, text=text_col)
