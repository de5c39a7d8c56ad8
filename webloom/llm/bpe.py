"""Byte-level BPE by a lazily determinised transducer, and streaming UTF-8 decoding.

Merges are compiled into a nondeterministic transducer: after each byte it may stand anywhere in
the trie of tokens where some token that began at an earlier byte can be. Sets of such places are
the states of the deterministic machine; a state and its moves are built when first met, with the
tokens that end there. A token may follow another only where the pair is *compatible*: merging the
bytes of both gives just these two tokens (compiled from the merges when first met). A sequence of
tokens, each the merge of its own bytes and all neighbours compatible, is the one that the merges
give, so of the tokens that end at a byte exactly one follows what was read before it began; the
transducer keeps it in a register for that byte. A token is emitted once every place where the
machine stands has it behind itself, so lookahead is bounded by the longest token.

The split pattern cuts a text into pieces first; a piece that is itself a token is that token. The
distinct pieces of a batch go through the transducer in lockstep, a byte of each at a step: moves,
registers and known pairs are tables that numpy gathers from. Pieces of more than ``LOCKSTEP`` bytes
are read alone and emitted as they settle.

Decoding takes tokens a few at a time; a UTF-8 state machine holds back an unfinished character.

Defined results: null text is empty and has no tokens; any bytes have tokens (all single bytes
are in the vocabulary); very long texts and pieces are read whole; repeated rows each get a
row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Places of the table of known token pairs, a power of two; a new pair takes the place of an old one.
PAIR_SLOTS = 1 << 20
#: Pieces of at most so many bytes go in lockstep, so many at a time.
LOCKSTEP = 48
ABREAST = 1 << 14
#: A longer piece is emitted in parts of about so many bytes.
SETTLE = 256
#: Bytes of texts that are encoded together.
CHUNK = 2 << 20
#: Tokens that the decoder takes at a time.
DECODE_STEP = 8192
#: Kinds of bytes in a piece: letters, digits, other signs, blanks; beyond ASCII the pattern decides.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]], KIND[48:58], KIND[C.IS_BLANK], KIND[128:] = 0, 1, 3, 4
#: First bytes, in UTF-8, of white space that is none of the six blanks.
ODD_LEAD = np.zeros(256, bool)
ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.depth = [0]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = rank
        self.size = {v: len(k) for k, v in ranks.items()}
        self.none = 1 + max(self.token)
        self.sides: dict[int, tuple[bool, list, list]] = {}
        self.states: list[tuple[int, ...]] = [()]
        self.done: list[list[tuple[int, int]]] = [[]]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.words = pa.array(list(ranks), pa.binary())
        self.word_ranks = np.array(list(ranks.values()), np.uint32)
        # the same machine as tables: next state by state and byte (-1: not built), tokens by state
        self.move = np.full((256, 256), -1, np.int32)
        self.ending = np.full((256, 2), -1, np.int32)
        self.length = np.zeros(self.none + 1, np.int32)
        self.length[list(self.size)] = list(self.size.values())
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.fit = np.zeros(PAIR_SLOTS, bool)

    def merged(self, word: bytes) -> list[int]:
        """The merges of one short string, in rank order: the definition, for tests."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _ends(self, token: int) -> tuple[bool, list, list]:
        """Whether the token is the merge of its bytes; and its first and its last part over time,
        each as (part, rank of the merge that made it)."""
        known = self.sides.get(token)
        if known is None:
            parts = [bytes([b]) for b in self.token[token]]
            first, last = [(parts[0], -1)], [(parts[-1], -1)]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append((parts[0], rank))
                if at == len(parts) - 1:
                    last.append((parts[-1], rank))
            known = self.sides[token] = (len(parts) == 1, first, last)
        return known

    def _may_follow(self, last: int, token: int) -> bool:
        """Merges go by rank, so both sides of the seam change at known ranks; the tokens stay
        apart unless at some time the merge across the seam comes first. Of merges of one rank the
        leftmost comes first."""
        sound, right, _ = self._ends(token)
        if not sound or last == self.none:
            return sound
        left, i, j = self._ends(last)[2], 0, 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else 1 << 60
            next_right = right[j + 1][1] if j + 1 < len(right) else 1 << 60
            across = self.ranks.get(left[i][0] + right[j][0], 1 << 60)
            if across < next_left and across <= next_right and across < 1 << 60:
                return False
            if next_left == next_right == 1 << 60:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _build(self, state: int, byte: int) -> int:
        """The set of places after one more byte, deepest first, and the sound tokens ending there."""
        child = self.child
        made = tuple(n for p in (*self.states[state], 0) if (n := child.get(p << 8 | byte)) is not None)
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
            tokens = [self.ends[n] for n in made if n in self.ends]
            sound = [(t, self.size[t]) for t in tokens if self._ends(t)[0]]
            self.done.append(sound)
            if number == len(self.move):
                self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
                self.ending = np.concatenate([self.ending, np.full_like(self.ending, -1)])
            if len(sound) > self.ending.shape[1]:
                self.ending = np.pad(self.ending, ((0, 0), (0, len(sound) - self.ending.shape[1])), constant_values=-1)
            self.ending[number, : len(sound)] = [t for t, _ in sound]
        self.move[state, byte] = number
        return number

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it."""
        key = before.astype(np.int64) << 20 | token
        slot = (key.view(np.uint64) * C.PLACE_BASE >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.fit[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            pairs, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self._may_follow(k >> 20, k & 0xFFFFF) for k in pairs.tolist()])
            out[new] = found[back]
            self.pair[slot[new[at]]], self.fit[slot[new[at]]] = pairs, found
        return out

    def abreast(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of short pieces, one after the other, and how many each has."""
        order = np.argsort(-size, kind="stable")  # long ones first: who has ended is a suffix
        begin, size = begin[order], size[order]
        last = np.full((len(size), int(size[0]) + 1), self.none, np.int32)
        state = np.zeros(len(size), np.int32)
        for i in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -i, side="right"))
            byte = data[begin[:n] + i - 1]
            nxt = self.move[state[:n], byte]
            if (nxt < 0).any():
                for key in np.unique(state[:n][nxt < 0].astype(np.int64) << 8 | byte[nxt < 0]).tolist():
                    self._build(key >> 8, key & 255)
                nxt = self.move[state[:n], byte]
            state = nxt
            open_ = np.arange(n)
            for c in range(self.ending.shape[1]):
                token = self.ending[state[open_], c]
                some = token >= 0
                if not some.all():  # no further token ends here
                    raise ValueError("a byte is not in the vocabulary")
                ok = self._fits(last[open_, i - self.length[token]], token)
                last[open_[ok], i] = token[ok]
                open_ = open_[~ok]
                if not len(open_):
                    break
        at, rows, back = size.copy(), np.arange(len(size)), []
        while len(rows):
            token = last[rows, at[rows]]
            back.append((rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        count = np.zeros(len(size), np.int64)
        for rows, _ in back:
            count[rows] += 1
        home = np.empty(len(size), np.int64)
        home[order] = np.arange(len(size))
        counts = count[home]
        end = np.cumsum(counts)[order]
        out = np.empty(int(counts.sum()), np.uint32)
        for k, (rows, token) in enumerate(back):
            out[end[rows] - 1 - k] = token
        return out, counts

    def _settled(self, last: list[int], state: int) -> int:
        """The byte up to which tokens are certain, whatever follows."""
        at = len(last) - 1
        fronts = {at, *(at - self.depth[n] for n in self.states[state])}
        while len(fronts) > 1:
            far = max(fronts)
            fronts.remove(far)
            fronts.add(far - self.size[last[far]] if far else 0)
        return fronts.pop()

    def _behind(self, last: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece, of any length."""
        state, last, out, limit = 0, [self.none], [], SETTLE
        known: dict[int, bool] = {}
        for b in data:
            nxt = int(self.move[state, b])
            state = self._build(state, b) if nxt < 0 else nxt
            i = len(last)
            for token, size in self.done[state]:
                before = last[i - size]
                ok = known.get(before << 20 | token)
                if ok is None:
                    ok = known[before << 20 | token] = self._may_follow(before, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {b}")
            if i >= limit:  # give what is certain and keep the rest
                sure = self._settled(last, state)
                out += self._behind(last, sure)
                if sure:
                    last = last[sure:]
                    last[0] = out[-1]
                limit = len(last) - 1 + SETTLE
        return out + self._behind(last, len(last) - 1)

    def tokens(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces raw[off[i]:off[i+1]], one after the other, and how many each has."""
        pieces = C.strings(raw, off, pa.binary())
        whole = pc.index_in(pieces, value_set=self.words).fill_null(-1).to_numpy()
        size = np.diff(off)
        counts = np.ones(len(size), np.int64)
        counts[size == 0] = 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (places, their tokens in a row)
        rest = np.flatnonzero((whole < 0) & (size > 0))
        long = size[rest] > LOCKSTEP
        short = rest[~long]
        short = short[np.argsort(size[short], kind="stable")]
        for a in range(0, len(short), ABREAST):
            at = short[a : a + ABREAST]
            ids, counts[at] = self.abreast(raw, off[:-1][at], size[at])
            parts.append((at, ids))
        for i in rest[long].tolist():
            ids = np.array(self.piece(raw[off[i] : off[i + 1]].tobytes()), np.uint32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[first[whole >= 0]] = self.word_ranks[whole[whole >= 0]]
        for at, ids in parts:
            out[ragged(first[at], counts[at])] = ids
        return out, counts


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] numbers; then those of the next; ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(int(counts.sum()))


def _utf8_machine() -> list[list[int]]:
    """Next state by state and byte. 0: between characters; 1, 2, 3: so many more bytes; 4 to 7: after
    E0, ED, F0, F4, whose second byte is restricted; -1: no such character."""
    table = [[-1] * 256 for _ in range(8)]
    for first, last, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        table[0][first : last + 1] = [to] * (last + 1 - first)
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][first : last + 1] = [to] * (last + 1 - first)
    return table


class Utf8Stream:
    """Incremental UTF-8: takes bytes as they come, gives the text of whole characters.

    The machine's state depends on the bytes since the last lead byte alone, so only these are
    walked when bytes arrive; an unfinished character is held back (at most three bytes). What no
    character can hold goes by ``errors``: "replace" gives U+FFFD; its bytes come out as they are.
    """

    MACHINE = _utf8_machine()

    def __init__(self, errors: str = "replace") -> None:
        self.held, self.errors = b"", errors

    def whole(self, data: bytes) -> bytes:
        """The bytes of the characters that are finished with ``data``."""
        data = self.held + data if self.held else data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if data[-back] >= 0xC0 or data[-back] < 0x80:  # a lead byte, or a character of its own
                state = 0
                for byte in data[-back:]:
                    state = self.MACHINE[state][byte]
                    if state < 0:
                        break
                if state > 0:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut]

    def feed(self, data: bytes) -> str:
        return self.whole(data).decode("utf-8", self.errors)

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", self.errors), b""
        return out


def decode_stream(tokens, token: list[bytes] | dict[int, bytes], step: int = DECODE_STEP, errors: str = "replace") -> Iterator[str]:
    """The text of a sequence of tokens, ``step`` tokens at a time."""
    stream = Utf8Stream(errors)
    for at in range(0, len(tokens), step):
        yield stream.feed(b"".join(map(token.__getitem__, tokens[at : at + step])))
    yield stream.end()


def follow(values: np.ndarray, top: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[top[i]:top[i+1]] for i in ``which``, one after the other, and their lengths."""
    counts = np.diff(top)[which]
    return values[ragged(top[which], counts)], counts


class Encoder:
    """Whole texts by a split pattern and a transducer.

    With the usual pattern, a run of blanks is parted before its last one, which begins the next
    piece if it is a space; so texts are cut there by masks over their bytes, and only distinct
    segments meet the pattern. Texts with other white space, and other patterns, are cut by the
    pattern alone.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers
        import regex

        self.machine = Transducer(ranks)
        self.token = [self.machine.token.get(i, b"") for i in range(max(self.machine.token) + 1)]
        self.token_bytes, self.token_off = C.text_buffers(pa.array(self.token, pa.binary()))
        self.find = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN

    def starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where segments of the texts raw[off[i]:off[i+1]] begin."""
        n = len(raw)
        blank = C.IS_BLANK[raw]
        after = np.append(blank, False)  # is the byte at i blank
        before = np.insert(blank, 0, False)  # is the byte before i blank
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begin = edge | (after & ~before)
        ends = np.flatnonzero(before & ~after & ~edge)  # a run of blanks ends here, inside a text
        begin[ends - 1] = True
        begin[ends[raw[ends - 1] != 32]] = True
        begin[n] = False
        odd: set[int] = set(range(len(off) - 1))
        if self.plain:
            at = np.flatnonzero(ODD_LEAD[raw])
            odd = {int(np.searchsorted(off, i, side="right")) - 1 for i in at.tolist() if _ODD_SPACE.match(raw[i : i + 3].tobytes())} if len(at) else set()
        for i in odd:
            at = int(off[i])
            begin[at : int(off[i + 1])] = False
            for piece in self.find(raw[off[i] : off[i + 1]].tobytes().decode()):
                begin[at] = True
                at += len(piece.encode())
        return np.flatnonzero(begin)

    def pieces(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of segments, where their pieces begin and end, and the number of the first piece of each."""
        raw, off = C.text_buffers(segments)
        if not self.plain:
            return raw, off, np.arange(len(off))
        kind = KIND[raw]
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != 3)  # a space goes with what follows it
        cut[off] = True
        hard = np.flatnonzero((kind == 4) | (raw == 39))  # beyond ASCII, or an apostrophe
        for i in np.unique(np.searchsorted(off, hard, side="right") - 1).tolist():
            a, b = int(off[i]), int(off[i + 1])
            cut[a + 1 : b] = False
            segment = raw[a:b].tobytes().decode()
            if not (segment.isalpha() or segment[0] == " " and segment[1:].isalpha()):
                for piece in self.find(segment):
                    cut[a] = True
                    a += len(piece.encode())
        begin = np.flatnonzero(cut)
        return raw, begin, np.searchsorted(begin, off)

    def batch(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts, one after the other, and where each text's begin."""
        starts = self.starts(raw, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        found = C.strings(raw, np.append(starts, len(raw)), pa.string()).dictionary_encode()
        data, begin, edge = self.pieces(found.dictionary)
        distinct = C.strings(data, begin, pa.string()).dictionary_encode()
        ids, counts = self.machine.tokens(*C.text_buffers(distinct.dictionary))
        top = np.append(0, np.cumsum(counts))
        ids, counts = follow(ids, top, distinct.indices.to_numpy())
        top = np.append(0, np.cumsum(counts))[edge]
        out, counts = follow(ids, top, found.indices.to_numpy())
        place = np.append(0, np.cumsum(counts))
        return out, place[np.searchsorted(starts, off)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's tokens, by the stream."""
        stream, out = Utf8Stream(), []
        for at in range(0, len(ids), DECODE_STEP):
            out.append(stream.whole(follow(self.token_bytes, self.token_off, ids[at : at + DECODE_STEP])[0].tobytes()))
        return b"".join([*out, stream.held])

    def __call__(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.batch(raw, np.array([0, len(raw)]))[0].tobytes()


#: By rank file and pattern, what a worker process has compiled; later tasks there use it too.
_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (len(data), hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def _run(ranks, pattern: str, decode: bool):
    def run(batches):
        encode = _encoder(ranks.value, pattern)
        for batch in batches:
            raw, off = C.text_buffers(batch.column(1))
            for a, b in C.chunks(off, CHUNK):
                yield _encoded(batch.column(0).slice(a, b - a), raw[off[a] : off[b]], off[a : b + 1] - off[a], encode, decode)

    return run


def _encoded(id_: pa.Array, raw: np.ndarray, off: np.ndarray, encode: Encoder, decode: bool) -> pa.RecordBatch:
    ids, place = encode.batch(raw, off)
    packed = pa.Array.from_buffers(pa.large_binary(), len(id_), [None, pa.py_buffer(place * 4), pa.py_buffer(ids)])
    cols = [id_, packed.cast(pa.binary())]
    if decode:
        cols.append(pa.array([encode.decoded(ids[a:b]) for a, b in zip(place.tolist(), place[1:].tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: 2 + decode])


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: id_col, ids binary (little-endian unsigned 32-bit), and with
    ``decode`` the bytes decoded from them. The rank file is read on the driver and sent along."""
    spark = docs.sparkSession
    C.ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {dict(docs.dtypes)['id']}, ids binary" + ", decoded binary" * decode
    return docs.mapInArrow(C.tidy(_run(ranks, pattern, decode)), schema).withColumnRenamed("id", id_col)
