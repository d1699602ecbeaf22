"""Encoding with a public byte-level BPE vocabulary, by a lazily determinised transducer.

In a BPE encoding every prefix of the tokens is itself the encoding of its bytes, and a
token sequence is the encoding of its bytes exactly if each two neighbours encode to
themselves. So the encoding of a prefix ends in the one token t whose left part's
encoding ends in a token compatible with t. ``Transducer`` turns this into an automaton
over bytes: a state holds, for each place from which the bytes read so far could still
grow into a token, the tokens not yet certain before that place. What all these places
agree on can no longer change and is emitted; the lookahead is bounded by the longest
token. States and transitions are made lazily, when needed for the second time, and kept
in a table of bounded size; before that the live places are followed as they are.

``Decoder`` goes back from ids to text piece by piece through an incremental UTF-8
state machine. The vocabulary's path is a parameter; the driver reads the file (checked
against ``MAX_FILE``) and broadcasts it.
"""

from __future__ import annotations

import base64
import gc
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dokuma.session import small_batches, spread
from dokuma.sources.tables import table

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCAB = "byte_bpe_50k.tiktoken"
#: Bytes a vocabulary file may have to be broadcast.
MAX_FILE = 64 << 20
#: Splits text before the merges; the published pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece memo and of the transition table before they are started anew.
MEMO, TRANSITIONS = 400_000, 400_000
#: Longer pieces always go through the transducer.
MEMO_CHARS = 48
_NEVER = 1 << 30
_FRESH = ((0, ()),)  # the only live place is here, with nothing uncertain before it


def read_vocabulary(path: str) -> bytes:
    """The file's bytes; an error if it is larger than what may be broadcast."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank, which is its id, of a file with a base64 token and a rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[int]:
    """The plain definition: merge the neighbours of the lowest rank until none is left
    (or none under ``below``)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < below and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes to ids. State 0 is the start; ``ends[s]`` are the ids that finish in state s."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        # a trie of the tokens: child[node << 8 | byte] is 4 * node + 2 * (it is a token) + (it may grow on)
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        child, token_at = self.child, self.token_at
        for t, i in ranks.items():
            node = 0
            for k, b in enumerate(t):
                key = node << 8 | b
                got = child.get(key)
                if got is None:
                    got = child[key] = len(token_at) << 2
                    token_at.append(-1)
                if k + 1 < len(t):
                    if not got & 1:
                        child[key] = got | 1
                else:
                    child[key] = got | 2
                    token_at[got >> 2] = i
                node = got >> 2
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.lefts: dict[int, list] = {}
        self.rights: dict[int, list] = {}
        self._reset()

    def _reset(self) -> None:
        start = (-1, _FRESH)
        self.states, self.number, self.ends = [start], {start: 0}, [()]
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: set[int] = set()

    def _spine(self, t: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The tokens that stand at one edge of t while it is merged together, from the
        single byte to t, each with the ranks between which it stands there."""
        got = (self.rights if right else self.lefts).get(t)
        if got is None:
            if len(self.token[t]) == 1:
                got = [(self.token[t], -1, _NEVER)]
            else:
                half = self._halves(t)[right]
                got = [*self._spine(half, right)[:-1], (self.token[half], self._spine(half, right)[-1][1], t), (self.token[t], t, _NEVER)]
            (self.rights if right else self.lefts)[t] = got
        return got

    def _halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge, the one of rank t, makes t."""
        got = self.halves.get(t)
        if got is None:
            left, right = merge(self.token[t], self.ranks, t)
            got = self.halves[t] = (left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        """Whether left + right encode to themselves: no merge across their border comes
        up while its two sides stand there. Of equal ranks the leftmost merge is first,
        so a merge inside left goes before one of the same rank across, which in turn
        goes before one inside right."""
        ok = self.fits.get(left << 20 | right)
        if ok is None:
            ok = True
            ranks = self.ranks
            first = self._spine(right, False)
            for a, a_from, a_to in self._spine(left, True):
                for b, b_from, b_to in first:
                    if b_from < a_to and a_from <= b_to:
                        c = ranks.get(a + b)
                        if c is not None and a_from < c < a_to and b_from < c <= b_to:
                            ok = False
                            break
                if not ok:
                    break
            if len(self.fits) >= TRANSITIONS:
                self.fits.clear()
            self.fits[left << 20 | right] = ok
        return ok

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition on a byte: a live place is (trie node of the bytes since
        it, uncertain tokens before it)."""
        last, places = self.states[state]
        here, live = None, []
        child, fits, token_at = self.child, self.fits, self.token_at
        for since, chain in places:
            grown = child.get(since << 8 | byte)
            if grown is None:
                continue
            if grown & 2 and here is None:
                t = token_at[grown >> 2]
                left = chain[-1] if chain else last
                ok = left < 0 or fits.get(left << 20 | t)
                if ok or ok is None and self._compatible(left, t):
                    here = (*chain, t)
            if grown & 1:
                live.append((grown >> 2, chain))
        if not live:  # nothing can grow on: all is certain
            key, out = (here[-1], _FRESH), here
        else:
            live.append((0, here))
            out = live[0][1]  # the oldest place has the fewest uncertain tokens
            if out:
                sure = len(out)
                for _, ch in live:
                    while ch[:sure] != out[:sure]:
                        sure -= 1
                if sure:
                    last, out = out[sure - 1], out[:sure]
                    live = [(g, ch[sure:]) for g, ch in live]
                else:
                    out = ()
            key = (last, tuple(live))
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.ends.append(key[1][-1][1])
        return n, out

    def _finish(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The ids still to come when ``rest`` is read from a state, without making states."""
        last, places = self.states[state]
        child, fits, token_at = self.child, self.fits, self.token_at
        for byte in rest:
            here, live = None, []
            for since, chain in places:
                grown = child.get(since << 8 | byte)
                if grown is None:
                    continue
                if grown & 2 and here is None:
                    t = token_at[grown >> 2]
                    left = chain[-1] if chain else last
                    ok = left < 0 or fits.get(left << 20 | t)
                    if ok or ok is None and self._compatible(left, t):
                        here = (*chain, t)
                if grown & 1:
                    live.append((grown >> 2, chain))
            live.append((0, here))
            places = live
        return places[-1][1]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """A transition is made when it is needed for the second time, or in a long piece;
        what follows a first need is read off the live places alone."""
        out: list[int] = []
        state, step, met = 0, self.step, self.met
        for i, b in enumerate(piece):
            key = state << 8 | b
            move = step.get(key)
            if move is None:
                if key not in met and len(piece) <= MEMO_CHARS:
                    if len(met) >= TRANSITIONS:
                        met.clear()
                    met.add(key)
                    out.extend(self._finish(state, piece[i:]))
                    return out
                if len(step) >= TRANSITIONS:
                    last = self.states[state]
                    self._reset()
                    step, state = self.step, self.number.setdefault(last, len(self.states))
                    if state == len(self.states):
                        self.states.append(last)
                        self.ends.append(last[1][-1][1])
                    key = state << 8 | b
                move = step[key] = self._make(state, b)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.ends[state])
        return out


class _Memo(dict):
    """piece -> its ids as bytes of 32-bit integers; what is missing goes through the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.encode_bytes = transducer.encode_bytes

    def __missing__(self, piece: str) -> bytes:
        got = array("i", self.encode_bytes(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Texts to ids: the published pattern cuts pieces, the transducer encodes each."""

    def __init__(self, data: bytes):
        import regex

        self.transducer = Transducer(parse_ranks(data))
        self.memo = _Memo(self.transducer)
        self.pieces = regex.compile(PATTERN).findall

    def encode_packed(self, text: str | None) -> bytes:
        """Ids without special tokens, as bytes of 32-bit integers; none for null and empty texts."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give an empty list."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()


class Decoder:
    """Ids to text, piece by piece. Bytes of an unfinished sign are held back until the
    ids that finish it; a broken sequence comes out as U+FFFD. ``finish`` ends the stream."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.held = b""

    @staticmethod
    def _need(lead: int) -> int:
        """Bytes of the sign that this byte leads; 1 also for bytes that lead none."""
        return 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1

    def feed(self, ids: list[int]) -> str:
        data = self.held + b"".join(self.token[i] for i in ids)
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                if self._need(b) > back:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """One encoder a Python worker, kept between batches and tasks."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids): the ids of each row's whole text, in one pass without a shuffle.

    Null and empty texts give an empty list; nothing is dropped or cut. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(read_vocabulary(path or os.path.join(TOKENIZERS, VOCAB)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the encoder's tables hold no cycles, and the collector would walk through every state again and again
        try:
            enc = encoder_of(held.value).encode_packed
            for batch in batches:
                packed = [enc(t) for t in batch.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, "ids"])
        finally:
            gc.enable()

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None, chunk: int = 64) -> DataFrame:
    """(id_col, text): texts of ids, fed to the streaming decoder in chunks. Null ids give null."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(path or os.path.join(TOKENIZERS, VOCAB)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder_of(held.value).transducer.token
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                d = Decoder(token)
                parts = [d.feed(ids[k : k + chunk]) for k in range(0, len(ids), chunk)]
                out.append("".join(parts) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts after encoding and streaming decoding."""
    return decode(p8_ids(spark, folder))


