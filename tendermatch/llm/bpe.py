"""Operator 10: byte-level BPE as a lazily determinised finite-state transducer.

For rank-ordered merges the encoding of every prefix of a piece extends the
encoding of a shorter prefix by one token, and that token is the only one
whose pair with the token before it is left alone by the merges. The
transducer reads one byte at a time and follows all prefixes from which a
token may still reach past the present byte (a prefix after whose last token
no such token can stand is given up); the tokens on which all of them agree are final and are emitted. The set of those hypotheses, with positions
dropped, is a state; states and their transitions are made when a text first
needs them and kept in a table of bounded size (a full table is emptied, which
costs time only). The lookahead is bounded by the longest token.

Decoding streams: tokens are turned into bytes chunk by chunk and a small
UTF-8 automaton holds back the bytes of a character that is not complete yet.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermatch.llm.common import held, ship

MAX_STATES = 250_000     # states a worker keeps
FEW = 24                 # tokens below a trie node that are looked at one by one
LOOKAHEAD = 1 << 10      # bytes after which a piece's ids are emitted as soon as they are final
MAX_PAIRS = 100_000      # token pairs of which a worker knows whether the merges leave them alone
MAX_PIECES = 300_000     # pieces whose ids a worker remembers
LONG_PIECE = 48          # longer pieces go through the transducer every time
LONG_TEXT = 1 << 20      # code points from which pieces are streamed
NEVER = 1 << 60          # rank of what is never merged
OUT_IDS = 1 << 20        # ids after which a worker hands on its rows
CHUNK = 1 << 14          # pieces encoded, or ids decoded, at a time


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """``token in base64, blank, rank`` per line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class State(dict):
    """Transitions of a state by byte, made when first needed."""

    __slots__ = ("machine", "key")

    def __init__(self, machine: Transducer, key: tuple[int, ...]):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, byte: int) -> tuple[State, int]:
        step = self[byte] = self.machine.move(self.key, byte)
        return step


class Transducer:
    """Merges compiled into byte transitions. A state holds a (trie node, last
    token) pair for every start of a token that may still grow; a transition
    gives the next state and the last token of the prefix read so far."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.child: dict[int, int] = {}          # trie: node * 256 + byte -> node
        self.token: list[int] = [-1]             # token that ends at a node
        below: list[list[int] | None] = [None]   # tokens below a node, None beyond FEW
        for piece, rank in sorted(ranks.items()):
            node, path = 0, []
            for b in piece:
                path.append(node)
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    below.append([])
                node = nxt
            self.token[node] = rank
            for at in path:
                if (known := below[at]) is not None:
                    known.append(rank)
                    if len(known) > FEW:
                        below[at] = None
        self.below = below
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.hopes: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self._empty()

    def _empty(self, key: tuple[int, ...] = (0, -1)) -> State:
        """Forget all states but ``key``."""
        self.states: dict[tuple[int, ...], State] = {}
        self.start = self._state((0, -1))
        return self._state(key)

    def _state(self, key: tuple[int, ...]) -> State:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(self, key)
        return state

    def merged(self, data: bytes, trace: list | None = None) -> list[bytes]:
        """The merges applied one by one, lowest rank first: the definition."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            if trace is not None:
                trace.append((rank, parts[0], parts[-1], at == 0, at == len(parts) - 2))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list, list] | None:
        """First and last segment of a token while it is merged, each with the
        rank of the merge that replaces it; None where the merges do not form
        this token or come in no rising order."""
        if token not in self.edges:
            data, trace = self.bytes_of[token], []
            whole = self.merged(data, trace) == [data]
            order = [x[0] for x in trace]
            if not whole or order != sorted(order):
                self.edges[token] = None
            else:
                self.edges[token] = ([(x[1], x[0]) for x in trace if x[3]] + [(data, NEVER)],
                                     [(x[2], x[0]) for x in trace if x[4]] + [(data, NEVER)])
        return self.edges[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave ``right`` after ``left`` as they are (left -1: the start)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._untouched(left, right)
        return known

    def _untouched(self, left: int, right: int) -> bool:
        own = self._edges(right)
        if left < 0 and own:
            return True
        before = self._edges(left) if left >= 0 else None
        if not own or not before:
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            return self.merged(a + b) == ([a, b] if a else [b])
        # a merge across the border comes before the next change of either side, or never
        heads, tails, i, j = own[0], before[1], 0, 0
        while True:
            (tail, tail_ends), (head, head_ends) = tails[i], heads[j]
            across = self.ranks.get(tail + head, NEVER)
            if across < tail_ends and across <= head_ends and across != NEVER:
                return False
            if tail_ends == head_ends == NEVER:
                return True
            if tail_ends <= head_ends:
                i += 1
            else:
                j += 1

    def _hopeful(self, last: int, node: int) -> bool:
        """Whether a token below ``node`` can follow ``last`` (or there are too many to look at)."""
        tokens = self.below[node]
        if not tokens:
            return tokens is None
        known = self.hopes.get((last, node))
        if known is None:
            if len(self.hopes) >= MAX_PAIRS:
                self.hopes.clear()
            known = self.hopes[last, node] = any(self.follows(last, t) for t in tokens)
        return known

    def move(self, key: tuple[int, ...], byte: int) -> tuple[State, int]:
        """State after a byte, and the last token of the prefix that it ends."""
        reached, found = [], -1
        live = iter(key)
        for node, last in zip(live, live):
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if found < 0 and self.token[nxt] >= 0 and self.follows(last, self.token[nxt]):
                found = self.token[nxt]
            if self._hopeful(last, nxt):
                reached += (nxt, last)
        if found < 0:
            raise ValueError("the ranks are not those of a byte-pair encoding")
        return self._state((*reached, 0, found)), found

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece. ``ends`` has the last token of each prefix
        not yet emitted; walking back through it gives the encoding."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._empty()
        state, out = self.start, []
        for begin in range(0, len(data), LOOKAHEAD):
            ends: list[int] = [] if not begin else ends
            for byte in data[begin:begin + LOOKAHEAD]:
                state, token = state[byte]
                ends.append(token)
                if len(ends) > LOOKAHEAD and len(state.key) == 2:       # no earlier start is open
                    out += self._walk(ends)
                    ends.clear()
            if len(self.states) > self.max_states:
                state = self._empty(state.key)
        return out + self._walk(ends)

    def _walk(self, ends: list[int]) -> list[int]:
        found, at = [], len(ends)
        while at:
            found.append(ends[at - 1])
            at -= self.size_of[ends[at - 1]]
        found.reverse()
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids of pieces met before, as little-endian bytes; the pieces of the last
    full table stay at hand in ``old``."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = _packed(self.transducer.encode(piece.encode("utf-8")))
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES):
        self.transducer = Transducer(ranks, max_states)
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self.transducer, max_pieces)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if len(text) < LONG_TEXT:
            return b"".join(map(get, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        out = bytearray()
        while part := b"".join(map(get, islice(found, CHUNK))):
            out += part
        return bytes(out)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, chunk by chunk; bytes that are no UTF-8 become U+FFFD."""
        machine, ids = Utf8Machine(), iter(ids)
        table = self.transducer.bytes_of
        while part := b"".join(map(table.__getitem__, islice(ids, CHUNK))):
            yield machine.feed(part)
        yield machine.end()


def codec(data: bytes, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> Codec:
    return Codec(parse_ranks(data), pattern, max_pieces, max_states)


class Utf8Machine:
    """Incremental UTF-8: states count the continuation bytes that a character
    still needs, with the narrower ranges of the byte after E0, ED, F0 and F4."""

    #: state: (lowest, highest next byte, state after it); 0 is the start. Fixed values of UTF-8.
    NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2),
            4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def lead(byte: int) -> int:
        """State after a first byte; 0 for one that stands alone or is none."""
        for low, high, state in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xE1, 0xEF, 2),
                                 (0xF0, 0xF0, 6), (0xF4, 0xF4, 7), (0xF1, 0xF3, 3)):
            if low <= byte <= high:
                return state
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for at in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[at] & 0xC0 == 0x80:
                continue
            state = self.lead(data[at])
            for byte in data[at + 1:]:
                low, high, after = self.NEXT.get(state, (1, 0, 0))
                state = after if low <= byte <= high else 0
            if state:
                cut = at
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """``<id_col>, n_tokens long, ids_sha256, decoded_sha256`` and, unless
    ``keep_ids`` is off, ``ids array<int>`` for every row of ``docs``.

    Rows are mapped one to one without a shuffle: repeated rows stay repeated,
    null ids stay null, a null or empty text has no ids, other columns are
    left out, and an empty table gives an empty one. ``ranks`` (the bytes of
    a rank file) goes to the workers as a broadcast variable; a worker compiles
    it once. ``max_pieces`` and ``max_states`` bound a worker's tables and change
    its memory and time only.
    """
    shared = ship(docs.sparkSession, ranks, pattern, max_pieces, max_states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(shared, codec)
        for batch in batches:
            counts, hashes, back, packed, begin, held_ids = [], [], [], [], 0, 0
            for row, text in enumerate(batch.column(1), 1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in own.decode(np.frombuffer(ids, dtype="<u4").tolist()):
                    digest.update(part.encode("utf-8"))
                back.append(digest.hexdigest())
                packed.append(ids if keep_ids else b"")
                held_ids += counts[-1]
                if row < batch.num_rows and (held_ids < OUT_IDS or not keep_ids):
                    continue
                out = [batch.column(0).slice(begin, row - begin), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                       pa.array(back, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                counts, hashes, back, packed, begin, held_ids = [], [], [], [], row, 0

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(table: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``table`` with the text of its ids in ``out_col`` (an existing column of
    that name is replaced); null ids give null."""
    shared = ship(table.sparkSession, ranks, pattern)

    @F.pandas_udf("string")
    def text(ids):
        own = held(shared, codec)
        return ids.map(lambda x: None if x is None else "".join(own.decode(x.tolist())))

    return table.withColumn(out_col, text(F.col(ids_col)))
