"""Byte-level BPE as a transducer, and decoding as a stream.

A sequence of tokens is what the merges make of its bytes exactly if that holds for each two neighbours: until a merge first
crosses the border of two tokens, what happens inside them is what would happen were nothing else there. So the merges are
compiled into a machine over bytes. A hypothesis is a token that ends somewhere and the path in the trie of tokens from there
to the present byte; it ends in a token that may stand beside the last one. One sequence is right for each prefix of the
input, so each start has one hypothesis. The machine is made deterministic as it is used: a state is the set of open
hypotheses, each with the tokens that it has and others have not; what all agree on is emitted. No hypothesis is open for
longer than the longest token, which bounds the lookahead. States and steps, once made, are one lookup a byte; tables have a
fixed size and start anew when full, which costs time only.

Two tokens may stand beside each other if no merge over their border comes before the merges that grow the pieces there: the
pieces along the border, in the order in which they are made, are compared. This holds for vocabularies in which each token is
what the merges make of its bytes and ranks above its parts; of others, pairs are tried by plain merging.

Each match of the pattern is encoded separately, as the library does, and one that is a token as a whole is that token. Decoding
takes ids one at a time through a state machine of UTF-8: a state is the bytes of a character that is not complete yet. Bytes
that cannot be part of one become U+FFFD, one for each part that could have begun a character.

Null counts as the empty text, which has no tokens. Texts that are not valid UTF-8 are read with U+FFFD in place of what is
not. Rows are independent: repeated rows give equal rows, an empty table an empty result, further columns are ignored. Strings
of special tokens are text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from mailquarry.llm.common import table, utf8

RANKS = "byte_bpe_50k.tiktoken"
#: States of the transducer, matches of the pattern and digests of texts that a worker remembers.
STATES, PIECES, TEXTS = 1 << 18, 1 << 19, 1 << 15
#: Up to so many tokens are tried to close a hypothesis early.
FEW = 32
_NEVER = 1 << 62


def ranks_of(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The pieces left when no merge is possible, lowest rank and leftmost first, and the last two that were merged."""
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if rank == _NEVER:
            break
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Transducer:
    """Bytes in, ids out; compiled from ranks."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pieces: int = PIECES):
        self.ranks, self.bytes, self.most, self.most_pieces = ranks, {i: t for t, i in ranks.items()}, states, pieces
        parts = {t: merged(t, ranks) for t in ranks}
        self.whole = {t for t, (left, _) in parts.items() if len(left) == 1}
        self.made_of = {t: last for t, (left, last) in parts.items() if len(left) == 1 and last}
        self.ordered = len(self.whole) == len(ranks) and all(max(map(ranks.__getitem__, p)) < ranks[t] for t, p in self.made_of.items())
        self.child: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for t in self.whole:
            node = 0
            for b in t:
                then = self.child[node].get(b)
                if then is None:
                    then = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = then
            self.token_at[node] = ranks[t]
        self.below = self._below()
        self.beside: dict[int, bool] = {}
        self.open: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], tuple[int, ...]] = {}
        self.known = _Known(self)
        self._restart()

    def _restart(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        #: (state after, what is settled) by state * 256 + byte
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.begin = self._numbered(((-1, 0, ()),))

    def _numbered(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.state)
            self.state.append(state)
        return at

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """The pieces that are at one end of the token while it is made, as ids, first to last, and what never comes: side 0 is
        its start, 1 its end."""
        out = self.edges.get((token, side))
        if out is None:
            pair = self.made_of.get(self.bytes[token])
            out = self.edges[token, side] = (*(self._edge(self.ranks[pair[side]], side)[:-1] if pair else ()), token, _NEVER)
        return out

    def _below(self) -> list[list[int] | None]:
        """The tokens that go on from each node of the trie, None for more than FEW. Nodes come after those they go on from."""
        out: list[list[int] | None] = [[] for _ in self.child]
        for node in range(len(self.child) - 1, -1, -1):
            for then in self.child[node].values():
                more, mine = out[then], out[node]
                if mine is not None:
                    here = [self.token_at[then]] if self.token_at[then] >= 0 else []
                    out[node] = None if more is None or len(mine) + len(more) + len(here) > FEW else mine + here + more
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave these two tokens as they are, one after the other."""
        key = a << 20 | b
        out = self.beside.get(key)
        if out is None:
            if len(self.beside) > 4 * self.most:
                self.beside.clear()
            out = self.beside[key] = self._may_follow(a, b) if self.ordered else merged(self.bytes[a] + self.bytes[b], self.ranks)[0] == [self.bytes[a], self.bytes[b]]
        return out

    def _may_follow(self, a: int, b: int) -> bool:
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        grows_left, grows_right, piece, beside, rank = left[1], right[1], self.bytes[left[0]], self.bytes[right[0]], self.ranks.get
        while True:
            across = rank(piece + beside)
            # of equal ranks the leftmost merge is first
            if across is not None and across < grows_left and across <= grows_right:
                return False
            if grows_left <= grows_right:
                if grows_left == _NEVER:
                    return True
                i += 1
                piece, grows_left = self.bytes[left[i]], left[i + 1]
            else:
                j += 1
                beside, grows_right = self.bytes[right[j]], right[j + 1]

    def may_end(self, last: int, node: int) -> bool:
        """False if none of the tokens that go on from this node of the trie may follow the last one. Where they are many, it
        is not tried: the hypothesis stays open a little longer."""
        if last < 0:
            return True
        key = last << 20 | node
        out = self.open.get(key)
        if out is None:
            if len(self.open) > 4 * self.most:
                self.open.clear()
            below = self.below[node]
            out = self.open[key] = below is None or any(self.may_follow(last, token) for token in below)
        return out

    def _step(self, at: int, b: int) -> tuple[int, tuple[int, ...]]:
        """The state after byte b, and what is settled by it. Hypotheses are in the order of their starts; the last one ends
        at the present byte."""
        after, ended = [], None
        for last, node, left in self.state[at]:
            node = self.child[node].get(b)
            if node is None:
                continue
            if ended is None:
                token = self.token_at[node]
                if token >= 0 and (last < 0 or self.may_follow(last, token)):
                    ended = token, 0, (*left, token)
            if self.child[node] and self.may_end(last, node):
                after.append((last, node, left))
        after.append(ended)
        settled = after[0][2]
        if settled:
            agreed = min(len(settled), min(len(left) for _, _, left in after))
            while agreed and any(left[:agreed] != settled[:agreed] for _, _, left in after):
                agreed -= 1
            settled = settled[:agreed]
            after = [(last, node, left[agreed:]) for last, node, left in after]
        if len(self.state) >= self.most:
            self._restart()
            return self._numbered(tuple(after)), settled
        out = self.steps[at << 8 | b] = self._numbered(tuple(after)), settled
        return out

    def run(self, piece: Iterable[int]) -> Iterator[tuple[int, ...]]:
        """The ids of a piece, given byte by byte, in runs as they are settled."""
        at = self.begin
        for b in piece:
            hit = self.steps.get(at << 8 | b)
            if hit is None:
                hit = self._step(at, b)
            at, settled = hit
            if settled:
                yield settled
        yield self.state[at][-1][2]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        return (rank,) if rank is not None else tuple(chain.from_iterable(self.run(piece)))

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.known.__getitem__, _split(text))))


class _Known(dict):
    """The ids of pieces met before; starts anew when full."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.machine.most_pieces:
            self.clear()
        out = self.machine.encode_piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = out
        return out


def after_byte(pending: bytes, b: int) -> tuple[str, bytes]:
    """What one more byte completes after an incomplete character, and what is then incomplete."""
    if not pending:
        if b < 0x80:
            return chr(b), b""
        return ("", bytes((b,))) if 0xC2 <= b <= 0xF4 else ("�", b"")
    lead = pending[0]
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        # neither longer forms than needed, nor surrogates, nor what is beyond the last character
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (low, high))
    if not low <= b <= high:
        text, left = after_byte(b"", b)
        return "�" + text, left
    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if len(pending) + 1 < need:
        return "", pending + bytes((b,))
    code = lead & 0xFF >> need + 1
    for c in (*pending[1:], b):
        code = code << 6 | c & 0x3F
    return chr(code), b""


class Decoder:
    """Ids in, text out, one at a time; the steps of whole tokens are put together from those of bytes as they are met."""

    def __init__(self, tokens: dict[int, bytes], most: int = STATES):
        self.tokens, self.most = tokens, most
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def _step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        out, at = [], pending
        for b in self.tokens[token]:
            text, at = after_byte(at, b)
            out.append(text)
        if len(self.steps) >= self.most:
            self.steps = {b"": {}}
        hit = self.steps.setdefault(pending, {})[token] = "".join(out), at
        return hit

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes; at the end U+FFFD for a character that is not complete."""
        at, steps = b"", self.steps[b""]
        for i in ids:
            hit = steps.get(i)
            if hit is None:
                hit = self._step(at, i)
            text, then = hit
            if then != at:
                at, steps = then, self.steps.setdefault(then, {})
            yield text
        if at:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


_MACHINES: dict[str, tuple[Transducer, Decoder]] = {}
_PATTERNS: dict[str, regex.Pattern] = {}


def machines(name: str = RANKS) -> tuple[Transducer, Decoder]:
    """Those of this vocabulary, made once a process."""
    if name not in _MACHINES:
        machine = Transducer(ranks_of(name))
        _MACHINES[name] = machine, Decoder(machine.bytes)
    return _MACHINES[name]


def _split(text: str) -> list[str]:
    if "" not in _PATTERNS:
        _PATTERNS[""] = regex.compile(pattern())
    return _PATTERNS[""].findall(text)


def _per_row(name: str, key: str, out: list[str], kinds: list[pa.DataType], column: str, make):
    """Arrow batches of the key and what make(machines, value) gives."""

    def run(batches):
        both = machines(name)
        # the tables hold no cycles: looking for some takes longer than the work
        gc.freeze()
        gc.disable()
        for batch in batches:
            rows = [make(both, x) for x in batch.column(column).to_pylist()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(key), *made], [key, *out])
        gc.enable()

    return run


def encode_documents(docs: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, ids array<long>) for each row of docs (key, text)."""
    rows = docs.select(F.col(key), utf8("text").alias("_t"))
    encode = _per_row(ranks, key, ["ids"], [pa.list_(pa.int64())], "_t", lambda both, t: (both[0].encode(t.decode("utf-8", "replace")).tolist(),))
    return rows.mapInArrow(encode, StructType([rows.schema[key], StructField("ids", ArrayType(LongType()))]))


def decode_documents(encoded: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, text) for each row of encoded (key, ids); null ids count as none."""
    rows = encoded.select(F.col(key), F.col("ids").cast("array<long>").alias("_ids"))
    decode = _per_row(ranks, key, ["text"], [pa.string()], "_ids", lambda both, ids: (both[1].decode(ids or []),))
    return rows.mapInArrow(decode, StructType([rows.schema[key], StructField("text", StringType())]))


def _digest(texts: dict):
    def make(both, data: bytes) -> tuple[int, str, str]:
        at = xxhash.xxh3_128_digest(data)
        out = texts.get(at)
        if out is None:
            if len(texts) >= TEXTS:
                texts.clear()
            ids = both[0].encode(data.decode("utf-8", "replace"))
            text = both[1].decode(ids)
            if ids.itemsize != 4:
                raise RuntimeError("an unsigned int has four bytes here")
            out = texts[at] = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        return out

    return make


def digest_documents(docs: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for each row of docs (key, text): encoded, and decoded from the ids, where the
    row is."""
    rows = docs.select(F.col(key), utf8("text").alias("_t"))
    out = ["n_tokens", "ids_sha256", "decoded_sha256"]
    digest = _per_row(ranks, key, out, [pa.int64(), pa.string(), pa.string()], "_t", _digest({}))
    return rows.mapInArrow(digest, StructType([rows.schema[key], StructField("n_tokens", LongType()), *[StructField(c, StringType()) for c in out[1:]]]))


def op12_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_byte_bpe_transducer": op12_byte_bpe_transducer}
