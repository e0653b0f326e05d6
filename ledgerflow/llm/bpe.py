"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Merges fix, for every byte string, the last token of its encoding, and a sequence of
tokens is an encoding exactly when each neighbouring pair is: (s, t) is *joinable* when
the merges turn the bytes of s + t into s, t again. So the encoding of a text is a path:
the last token at a position is the one token that ends there, starts at an earlier
position and is joinable with the last token there. The transducer reads a byte at a
time. Its state holds the positions at which a token that is still growing may start,
each as the place in the token trie that its growing token has reached and the last token
before it (a nondeterministic set, made one deterministic state). A move yields the last
token at the new position. The tokens up to the position that the paths to all live
positions share are certain and emitted; no live position is further back than the longest
token. States and moves are made when first needed and kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks
from ledgerflow.llm.text import pieces

#: Bounds of what a worker keeps between rows; beyond them it starts afresh.
MAX_STATES = 100_000
MAX_PIECES = 250_000
MAX_KEPT_PIECE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 bytes and a number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(data: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """The merges of one token, lowest rank first, leftmost on ties, until ``stop`` parts are left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > stop:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """The lazily determinised transducer of one rank table.

    A state is a flat tuple of live positions, oldest first: trie node, last token (-1 at the
    start of a text) and so on. The newest position is at the root, node 0. States are numbered
    as they are met; ``moves`` maps state * 256 + byte to state * 2**20 + last token at the new position."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.rank: list[int] = [-1]  # token that ends at a node, or -1
        self.grows: list[bool] = [True]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = 0
            for byte in token:
                self.grows[node] = True
                key = node * 256 + byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.rank)
                    self.rank.append(-1)
                    self.grows.append(False)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.rank[node] = rank
        self.length = [len(t) for t in self.tokens]
        self.number = list(range(len(self.tokens)))  # one object per id, however often it is kept
        self.longest = max(self.length, default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states and moves but the start."""
        start = (0, -1)
        self.numbers.clear()
        self.numbers[start] = 0
        self.states[:] = [start]
        self.moves.clear()

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token joins; None for a byte, or where merges end elsewhere."""
        if token not in self.halves:
            parts = merge(token, self.ranks, stop=2)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def joinable(self, s: int, t: int) -> bool:
        """Do the merges leave token t as it is at the start of a text (s -1), or after token s?

        Undo the merges inside both tokens from the latest to the earliest. If, before one of
        them was made, the parts on either side of the border would merge earlier, they join."""
        key = (s, t)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > 4 * MAX_STATES:
            self.pairs.clear()
        if s < 0:
            self.pairs[key] = merge(self.tokens[t], self.ranks) == [self.tokens[t]]
            return self.pairs[key]
        ok = self.pairs.get((-1, t))
        if ok is None:
            ok = self.joinable(-1, t)
        left, right = self.tokens[s], self.tokens[t]
        # Merges end before a moment: 4 * rank + side; at one rank the left side goes first, the border next.
        before, ranks, last_merge = 1 << 60, self.ranks, self.last_merge
        undo_left = 4 * ranks[left] if len(left) > 1 else -1
        undo_right = 4 * ranks[right] + 2 if len(right) > 1 else -1
        while ok:
            joint = ranks.get(left + right)
            if joint is not None and 4 * joint + 1 < before:
                ok = False
            elif undo_left > undo_right:
                before, left = undo_left, last_merge(left)[1]
                undo_left = 4 * ranks[left] if len(left) > 1 else -1
            elif undo_right >= 0:
                before, right = undo_right, last_merge(right)[0]
                undo_right = 4 * ranks[right] + 2 if len(right) > 1 else -1
            else:
                break
        self.pairs[key] = ok
        return ok

    def step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """State after one more byte, and the last token at the new position."""
        live: list[int] = []
        found = -1
        child, rank, grows, pairs = self.child, self.rank, self.grows, self.pairs
        places = iter(state)
        for at, before in zip(places, places):
            node = child.get(at << 8 | byte)
            if node is None:
                continue
            token = rank[node]
            if found < 0 <= token:
                ok = pairs.get((before, token))
                if ok or ok is None and self.joinable(before, token):
                    found = token
            if grows[node]:
                live += (node, before)
        if found < 0:
            raise ValueError(f"no token for byte {byte}")
        live += (0, found)
        return tuple(live), found

    def end(self, state: tuple[int, ...], byte: int) -> int:
        """The last token after a text's last byte: what ``step`` finds, without the state that nothing reads."""
        child, rank, pairs = self.child, self.rank, self.pairs
        places = iter(state)
        for at, before in zip(places, places):
            token = rank[child.get(at << 8 | byte, 0)]  # no token ends at the root
            if token >= 0:
                ok = pairs.get((before, token))
                if ok or ok is None and self.joinable(before, token):
                    return token
        raise ValueError(f"no token for byte {byte}")

    def move(self, at: int, byte: int) -> int:
        """A move that is not known yet. Tables that have grown too large are emptied first."""
        state, found = self.step(self.states[at], byte)
        number = self.numbers.get(state)
        if number is None:
            if len(self.states) >= MAX_STATES:
                self.clear()
                at = -1
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = number << 20 | found
        if at >= 0:
            self.moves[at << 8 | byte] = move
        return move

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(data) > 4 * self.longest:
            stream = Stream(self)
            return [t for i in range(0, len(data), self.longest) for t in stream.feed(data[i:i + self.longest])] \
                + stream.finish()
        if not data:
            return []
        at, last, known = 0, [], self.moves.get
        for byte in data[:-1]:
            move = known(at << 8 | byte)
            if move is None:
                move = self.move(at, byte)
            at = move >> 20
            last.append(move & 0xFFFFF)
        move = known(at << 8 | data[-1])
        last.append(self.end(self.states[at], data[-1]) if move is None else move & 0xFFFFF)
        return self.path(last, 0, len(last))

    def path(self, last: list[int], start: int, end: int) -> list[int]:
        """Tokens from one position to another, given the last token at each."""
        out = []
        length, number = self.length, self.number
        while end > start:
            token = last[end - 1]
            out.append(number[token])
            end -= length[token]
        out.reverse()
        return out


class Stream:
    """Encodes one piece that arrives in portions; holds the bytes of the lookahead only."""

    def __init__(self, machine: Transducer):
        self.machine, self.at = machine, 0
        self.last: list[int] = []  # last tokens at the positions after the last certain one

    def feed(self, data: bytes) -> list[int]:
        """Tokens that have become certain."""
        m = self.machine
        for byte in data:
            move = m.moves.get(self.at << 8 | byte)
            if move is None:
                move = m.move(self.at, byte)
            self.at = move >> 20
            self.last.append(move & 0xFFFFF)
        ends = {len(self.last) - m.depth[node] for node in m.states[self.at][::2]}
        while len(ends) > 1:  # the position that the paths to all live positions share
            far = max(ends)
            ends.remove(far)
            ends.add(far - m.length[self.last[far - 1]])
        shared = ends.pop()
        out = m.path(self.last, 0, shared)
        del self.last[:shared]
        return out

    def finish(self) -> list[int]:
        """The rest."""
        out = self.machine.path(self.last, 0, len(self.last))
        self.at, self.last = 0, []
        return out


class Encoder:
    """Encodes texts: each match of the pattern by itself; frequent short pieces are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.machine = Transducer(ranks)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.machine.encode(data))
        if len(piece) <= MAX_KEPT_PIECE:
            if len(self.known) >= MAX_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend, new = self.known.get, out.extend, self.piece
        for p in self.find(text):
            extend(known(p) or new(p))
        return out


#: UTF-8 state machine. States: 0 between characters; 1, 2, 3 more continuation bytes due;
#: 4 after E0, 5 after ED, 6 after F0, 7 after F4 (these narrow the next byte); 8 invalid.
BETWEEN, INVALID = 0, 8


def utf8_step(state: int, byte: int) -> int:
    """State after one byte."""
    if state == BETWEEN:
        if byte < 0x80:
            return BETWEEN
        if 0xC2 <= byte <= 0xDF:
            return 1
        if byte in (0xE0, 0xED):
            return 4 if byte == 0xE0 else 5
        if 0xE1 <= byte <= 0xEF:
            return 2
        if byte in (0xF0, 0xF4):
            return 6 if byte == 0xF0 else 7
        return 3 if 0xF1 <= byte <= 0xF3 else INVALID
    low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1),
                       5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, INVALID))
    return then if low <= byte <= high else INVALID


class Decoder:
    """Streaming decoder: token ids in any portions to bytes, tracked by the UTF-8 state machine.

    The machine's move over a whole token is kept per (state, token)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.decimal = list(map(str, range(len(tokens))))
        self.moves: dict[tuple[int, int], int] = {}
        #: Tokens that leave the machine between characters when they find it there.
        self.whole = np.array([self.move(BETWEEN, i) == BETWEEN for i in range(len(tokens))], bool)

    def move(self, state: int, token: int) -> int:
        for byte in self.tokens[token]:
            state = utf8_step(state, byte)
        return state

    def feed(self, state: int, ids: list[int]) -> tuple[bytes, int]:
        """Bytes of a portion and the machine's state after it."""
        data = b"".join(map(self.tokens.__getitem__, ids))
        at = 0
        odd = np.flatnonzero(~self.whole[np.asarray(ids, np.int64)]) if ids else ()
        for i in odd if state == BETWEEN else range(len(ids)):
            if i > at and state != BETWEEN:  # whole tokens met inside a character
                for j in range(at, i):
                    state = self._kept(state, ids[j])
            state = self._kept(state, ids[i])
            at = i + 1
        if state != BETWEEN:
            for j in range(at, len(ids)):
                state = self._kept(state, ids[j])
        return data, state

    def _kept(self, state: int, token: int) -> int:
        key = (state, token)
        after = self.moves.get(key)
        if after is None:
            after = self.moves[key] = self.move(state, token)
        return after


_encoders: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a rank file, kept per worker."""
    if (path, pattern) not in _encoders:
        ranks = load_ranks(path)
        e = Encoder(ranks, pattern)
        _encoders[(path, pattern)] = e, Decoder(e.machine.tokens)
    return _encoders[(path, pattern)]


def _per_text(docs: DataFrame, id_col: str, text_col: str, schema: str,
              make: Callable[[str | None], tuple], keep: tuple[str, ...] = ()) -> DataFrame:
    python_tasks(docs.sparkSession)
    schema = ", ".join([schema, *(f"{c} long" for c in keep)])
    kinds = pa.schema([("doc_id", pa.int64())] + [
        (c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(),
                        "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            rows = [make(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), *map(list, zip(*rows, strict=True)), *part.columns[2:]], schema=kinds)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        *[F.col(c).cast("long").alias(c) for c in keep])
    return plain.mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text, one row per row.

    Null text is empty and has no ids. Rows repeat and null doc_ids stay as they are. A text of any
    length is encoded whole; an empty table gives no rows. Other columns are not read. ``path`` names
    the rank file, which every machine has at that place."""
    return _per_text(docs, id_col, text_col, "ids array<int>", lambda t: (coder(path, pattern)[0].encode(t or ""),))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text and decode its ids again; edge cases as in ``encode``.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, valid): hashes of the comma-joined decimal ids and of
    the decoded bytes; ``valid`` when the decoder's state machine accepted them as complete UTF-8. The
    whole-number columns ``keep`` follow as they are."""

    def digest(text: str | None) -> tuple:
        encoder, decoder = coder(path, pattern)
        ids = encoder.encode(text or "")
        plain, state = hashlib.sha256(), BETWEEN
        for at in range(0, len(ids), 4096):
            data, state = decoder.feed(state, ids[at:at + 4096])
            plain.update(data)
        return (len(ids), hashlib.sha256(",".join(map(decoder.decimal.__getitem__, ids)).encode()).hexdigest(), plain.hexdigest(),
                state == BETWEEN)

    return _per_text(docs, id_col, text_col,
                     "n_tokens long, ids_sha256 string, decoded_sha256 string, valid boolean", digest, keep)
