"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding by a UTF-8 state machine.

The merges come as a file of ranks (base64 token, rank); its bytes go to the executors and are compiled there.

- *Transducer.* In an encoding every two neighbours are also the encoding of their own concatenation, and a row of
  tokens with that property is the only one. So the machine is nondeterministic in one thing only: which of the tokens that begin here and
  may follow the last one is next. Its state is the last token and a place in the trie of all tokens. It reads ahead as far as
  some token goes on, at most the longest, and then emits the longest that may follow. That decision is worked out when a state is first
  met, and kept: the machine is determinised as far as the texts need it. Where nothing can follow, that position is closed for good, because the
  encoding of a prefix is unique, and the token before it ends elsewhere; so the work is linear. Kept decisions
  are forgotten together when there are ``MOST_MOVES`` of them; that changes the work and not the result.
- *Pieces.* The pattern splits a text, and each match is encoded by itself. A piece that is a token as a whole is that token.
  The pattern must end a piece wherever a space follows something else than white space, as the public byte-level ones do: long texts are
  read in windows cut there, and what stands between two such places is looked up whole when it is met again.
- *Decoding.* A state is the bytes of an unfinished character; each token moves it and gives the text that is complete. Bytes
  that are no UTF-8 become U+FFFD, as soon as they can't be completed.

Defined cases: a null or empty text has no tokens; null ids decode to a null text, an empty list to an empty one; an id that is not in the
file is an error. Rows are independent, so repeated rows and null ids of documents need no rule; other columns are
handed through, but for one that has the name of the new one, which is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import operator
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seapoint.llm.words import slices

MOST_MOVES = 1 << 19
MOST_CHUNKS = 1 << 20
MOST_PIECES = 1 << 18
LONG_PIECE = 256
WINDOW = 1 << 20
_NOWHERE = (-1, 0)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines of a file of ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Transducer:
    """The merges of ``ranks`` as a machine that reads bytes and emits tokens.

    A state is the last token and a node: the bytes read after it, as a place in the trie of all tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes that are no tokens: {missing}")
        self._ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._child: dict[int, int] = {}
        self._path = [b""]
        self._longest = max(map(len, ranks))
        for token in ranks:
            node = 0
            for at, byte in enumerate(token, 1):
                key = node << 8 | byte
                node = self._child.get(key, 0)
                if not node:
                    node = self._child[key] = len(self._path)
                    self._path.append(token[:at])
        self._fits: dict[int, bool] = {}
        self._seams: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self._begun: dict[int, tuple[tuple[int, int], ...]] = {}
        self._moves: dict[int, tuple[int, int]] = {}

    def merged(self, text: bytes, until: int = 1) -> list[int]:
        """The merges applied one after another, the least rank first, the leftmost of equals; ``until`` so many parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > until:
            ranks = [self._ranks.get(a + b, len(self._bytes)) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == len(self._bytes):
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self._ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """What stands at the left and at the right edge while ``token`` is merged; None unless ranks only rise meanwhile."""
        edges = self._seams.get(token, False)
        if edges is False:
            edges, text = ((token,), (token,)), self._bytes[token]
            if len(text) > 1:
                left, *right = self.merged(text, 2)
                parts = [self._edges(t) for t in (left, *right) if t < token]
                edges = None
                if len(parts) == 2 and len(right) == 1 and None not in parts:
                    edges = (*parts[0][0], token), (*parts[1][1], token)
            self._seams[token] = edges
        return edges

    def _neighbours(self, left: int, right: int) -> bool:
        """``right`` may follow ``left`` (-1: nothing): no merge crosses from one to the other."""
        if len(self._fits) >= 1 << 20:
            self._fits.clear()
        before, after = left < 0 or self._edges(left), self._edges(right)
        if before is None or after is None:
            own = [right] if left < 0 else [left, right]
            fits = self.merged(b"".join(self._bytes[t] for t in own)) == own
        else:
            fits = left < 0 or self._apart(before[1], after[0])
        self._fits[(left + 1) << 32 | right] = fits
        return fits

    def _apart(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        """Both edges grow in the order of ranks; they stay apart if no pair of what stands there at one time is merged first."""
        never = len(self._bytes)
        i = j = 0
        while True:
            crossing = self._ranks.get(self._bytes[left[i]] + self._bytes[right[j]], never)
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            if crossing < grow_left and crossing <= grow_right and crossing < never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _ways(self, last: int, node: int) -> Iterator[tuple[int, int]]:
        """The tokens that begin the bytes of ``node`` and may follow ``last``, the longest first, with their lengths."""
        begun = self._begun.get(node)
        if begun is None:
            text = self._path[node]
            ranks = ((self._ranks.get(text[:n]), n) for n in range(len(text), 0, -1))
            begun = self._begun[node] = tuple(x for x in ranks if x[0] is not None)
        for token, length in begun:
            fits = self._fits.get((last + 1) << 32 | token)
            if self._neighbours(last, token) if fits is None else fits:
                yield token, length

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self._ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._moves) >= MOST_MOVES:
            self._moves.clear()
        child, moves = self._child, self._moves
        at, size, last, out = 0, len(piece), -1, []
        closed: set[int] = set()
        while at < size:
            node = 0
            for byte in piece[at : at + self._longest]:
                to = child.get(node << 8 | byte)
                if to is None:
                    break
                node = to
            state = (last + 1) << 32 | node
            move = moves.get(state)
            if move is None:
                move = moves[state] = next(self._ways(last, node), _NOWHERE)
            token, ahead = move
            if not ahead or at + ahead in closed:
                token, ahead = next((w for w in self._ways(last, node) if at + w[1] not in closed), _NOWHERE)
            if ahead:
                out.append(token)
                at += ahead
            else:  # nothing leads on from here, so the token before ends elsewhere
                closed.add(at)
                at -= len(self._bytes[out.pop()])
            last = out[-1] if out else -1
        return out


class _Kept(dict):
    """Results of ``make`` by text, the common and short ones kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, text: str):
        value = self._make(text)
        if len(text) <= LONG_PIECE:
            if len(self) >= self._most:
                self.clear()
            self[text] = value
        return value


def chunks(text: str) -> list[str]:
    """``text`` cut at each space that follows something else than white space, without that space. A piece always ends there."""
    parts = text.split(" ")
    if not all(parts) or any(map(str.isspace, map(operator.itemgetter(-1), parts))):
        joined, open_part = [], None
        for part in parts:
            open_part = part if open_part is None else f"{open_part} {part}"
            if part and not part[-1].isspace():
                joined.append(open_part)
                open_part = None
        parts = joined if open_part is None else [*joined, open_part]
    return parts


_CUT = regex.compile(r"(?<=\S) ")


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """``text`` in parts of about ``size``, cut before a space that follows something else."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        machine, split = Transducer(read_ranks(ranks)), regex.compile(pattern)
        pieces = _Kept(lambda piece: tuple(machine.encode(piece.encode())), MOST_PIECES)
        self._first = lambda chunk: tuple(chain.from_iterable(map(pieces.__getitem__, split.findall(chunk))))
        self._chunks = _Kept(lambda chunk: self._first(" " + chunk), MOST_CHUNKS)
        self.transducer = machine

    def parts(self, text: str) -> Iterator[list[int]]:
        """The tokens, window by window."""
        for window in windows(text):
            first, *rest = chunks(window)
            yield [*self._first(first), *chain.from_iterable(map(self._chunks.__getitem__, rest))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


#: First bytes and the ranges of the bytes that follow, as UTF-8 has them.
_TAIL = (0x80, 0xBF)
_FOLLOWING = (
    ((0xC2, 0xDF), (_TAIL,)),
    ((0xE0, 0xE0), ((0xA0, 0xBF), _TAIL)),
    ((0xE1, 0xEC), (_TAIL, _TAIL)),
    ((0xED, 0xED), ((0x80, 0x9F), _TAIL)),
    ((0xEE, 0xEF), (_TAIL, _TAIL)),
    ((0xF0, 0xF0), ((0x90, 0xBF), _TAIL, _TAIL)),
    ((0xF1, 0xF3), (_TAIL, _TAIL, _TAIL)),
    ((0xF4, 0xF4), ((0x80, 0x8F), _TAIL, _TAIL)),
)


def _wanted(pending: bytes) -> tuple[tuple[int, int], ...]:
    """Ranges of the bytes that complete the character begun by ``pending``; none if it can't be one."""
    for (low, high), following in _FOLLOWING:
        if low <= pending[0] <= high:
            return following[len(pending) - 1 :]
    return ()


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """The text that ``byte`` completes after an unfinished character, and what is unfinished then."""
    lost = ""
    if pending:
        low, high = _wanted(pending)[0]
        if low <= byte <= high:
            pending += bytes([byte])
            return ("", pending) if _wanted(pending) else (pending.decode(), b"")
        lost = "�"
    if byte < 0x80:
        return lost + chr(byte), b""
    start = bytes([byte])
    return (lost, start) if _wanted(start) else (lost + "�", b"")


class Decoder:
    """Tokens of one text after another; ``feed`` gives the text that is complete, ``close`` the rest."""

    def __init__(self, ranks: bytes):
        self._bytes = {rank: token for token, rank in read_ranks(ranks).items()}
        self._moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self._pending = b""

    def _move(self, pending: bytes, token: int) -> tuple[str, bytes]:
        if token not in self._bytes:
            raise ValueError(f"no token has the id {token}")
        out, state = [], pending
        for byte in self._bytes[token]:
            text, state = utf8_step(state, byte)
            out.append(text)
        move = self._moves[pending][token] = ("".join(out), state)
        self._moves.setdefault(state, {})
        return move

    def feed(self, tokens: Iterable[int]) -> str:
        pending, out = self._pending, []
        moves = self._moves[pending]
        for token in tokens:
            text, state = moves.get(token) or self._move(pending, token)
            out.append(text)
            if state != pending:
                pending, moves = state, self._moves[state]
        self._pending = pending
        return "".join(out)

    def close(self) -> str:
        rest, self._pending = self._pending, b""
        return "�" if rest else ""


def shared_file(spark: SparkSession, path: str):
    """The bytes of a vocabulary file (of bounded size), in a holder that every executor process has once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def in_process(holder, name: str, make):
    """What ``make`` builds from the shared file; built once per process, so that later tasks find its kept results."""
    held = holder.value
    if name not in held:
        held[name] = make(held["file"])
    return held[name]


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, values) -> DataFrame:
    """``df`` with the column ``name``, which ``values()`` makes from the column ``source`` in each task."""
    others = [c for c in df.columns if c != name]
    fed = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{source}`").alias("__source"))
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = values()
        for batch in batches:
            column = make(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], name])

    return fed.mapInArrow(run, schema)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``df`` with the ids of the column ``text`` (null: null)."""
    ranks = shared_file(df.sparkSession, ranks_path)

    def values():
        encoder = in_process(ranks, "encoder", lambda content: Encoder(content, pattern))
        return lambda column: pa.array([None if t is None else encoder.encode(t) for t in column.to_pylist()], pa.list_(pa.int32()))

    return _with_column(df, text, tokens, T.ArrayType(T.IntegerType()), values)


def decode_tokens(df: DataFrame, ranks_path: str, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``df`` with the text of the ids in the column ``tokens`` (null: null)."""
    ranks = shared_file(df.sparkSession, ranks_path)

    def values():
        decoder = in_process(ranks, "decoder", Decoder)
        return lambda column: pa.array([None if t is None else decoder.feed(t) + decoder.close() for t in column.to_pylist()], pa.string())

    return _with_column(df, tokens, text, T.StringType(), values)


def token_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, the number and digest of each text's ids, and the digest of what they decode to.

    Ids are made, hashed and decoded window by window, so a very long text is not held as ids.
    """
    ranks = shared_file(documents.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_process(ranks, "encoder", lambda content: Encoder(content, pattern))
        decoder = in_process(ranks, "decoder", Decoder)
        for batch, texts in slices(batches):
            counts, ids, decoded = [], [], []
            for text in texts:
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for tokens in encoder.parts((text or b"").decode("utf-8", "replace")):
                    of_ids.update((" " * bool(n) + " ".join(map(str, tokens))).encode())
                    of_bytes.update(decoder.feed(tokens).encode())
                    n += len(tokens)
                of_bytes.update(decoder.close().encode())
                counts.append(n)
                ids.append(of_ids.hexdigest())
                decoded.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
