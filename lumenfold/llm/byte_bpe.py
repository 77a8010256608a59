"""Byte-level BPE encoding and decoding without regular expressions.

Each code point gets a class from an array (letter, number, other, white space). A symbol adds what the neighbours
decide: an apostrophe that opens a contraction, a space before a non-space, white space before a non-space. A finite
automaton over these symbols yields the token starts. Its transition functions compose associatively: every block of
text is reduced to one function (all blocks in lockstep), the blocks' functions are composed in order, and a second
lockstep pass emits the boundaries. The slices then go through memoised pair merging by rank.

Rows: null or empty text = no ids. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LETTER, NUMBER, OTHER, SPACE = range(4)
# The code points of the White_Space property.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Symbols 0..2 are the classes; then: an apostrophe before s, t, m, d; before re, ve, ll; a space that the next
# token takes; white space before a non-space; other white space.
SHORT, LONG, TAKEN, LAST, RUN = 3, 4, 5, 6, 7
# States: nothing open; in letters, numbers, others, white space; after a taken space; one or two letters of a
# contraction to come.
IDLE, IN_L, IN_N, IN_O, IN_S, AFTER, ONE, TWO = range(8)
LANE = 128  # code points in a block of the scan
CHUNK = 1 << 20  # code points scanned at once
CACHE = 150_000  # pieces in one of the memo's two generations
SHORT_PIECE = 48  # longer pieces aren't remembered; beyond it merging keeps a heap


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, is a start) by [symbol, state]."""
    step, start = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        for symbol, inside in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
            step[symbol, state] = inside
            start[symbol, state] = state not in (inside, AFTER)
        for symbol, left in ((SHORT, ONE), (LONG, TWO)):
            open_run = state in (IN_O, AFTER)
            step[symbol, state], start[symbol, state] = (IN_O, False) if open_run else (left, True)
        step[TAKEN, state], step[LAST, state], step[RUN, state] = AFTER, IDLE, IN_S
        start[RUN, state] = state != IN_S
    step[LETTER, ONE], start[LETTER, ONE] = IDLE, False
    step[LETTER, TWO], start[LETTER, TWO] = ONE, False
    return step, start


STEP, START = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE_SPACE] = SPACE
    return out


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; first marks the first code point of each text."""
    kind = classes()[points]
    n = len(points)
    ends = np.append(first[1:], True)  # the last code point of its text
    nxt = np.full(n, SPACE, np.uint8)
    nxt[:-1] = kind[1:]
    nxt[ends] = SPACE
    out = kind.copy()
    white = kind == SPACE
    out[white] = np.where(nxt[white] == SPACE, RUN, np.where(points[white] == 32, TAKEN, LAST))
    quote = np.flatnonzero((points == 39) & ~ends)
    if len(quote):
        a = points[quote + 1]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        b = points[np.minimum(quote + 2, n - 1)]
        two = ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))) & ~ends[quote + 1]
        out[quote[one]], out[quote[two]] = SHORT, LONG
    return out


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a token: a block-wise scan of composed transition functions."""
    n = len(points)
    lanes = -(-n // LANE)
    code = np.full(lanes * LANE, RUN, np.uint8)
    code[:n] = symbols(points, first)
    reset = np.zeros(lanes * LANE, np.uint8)
    reset[:n] = first
    # A text's first code point maps every state to where the idle state goes: symbols 8..15.
    step = np.concatenate([STEP, np.repeat(STEP[:, IDLE : IDLE + 1], 8, 1)]).reshape(-1).astype(np.int16)
    begin = np.concatenate([START, np.ones_like(START)]).reshape(-1)
    symbol = (code + 8 * reset).reshape(lanes, LANE)
    code = np.ascontiguousarray(symbol.T).astype(np.int16) * 8
    # Composition of a block's functions. A constant function (a reset, a taken space, last white space) makes the
    # whole block's function constant, so one state stands for all eight; only the other blocks carry all of them.
    whole = np.zeros(lanes, np.int16)
    for row in code:
        whole = step.take(row + whole)
    whole = np.repeat(whole[:, None], 8, 1)
    free = np.flatnonzero(~((symbol >= 8) | (symbol == TAKEN) | (symbol == LAST)).any(1))
    if len(free):
        part = np.tile(np.arange(8, dtype=np.int16), (len(free), 1))
        for row in code[:, free]:
            part = step.take(row[:, None] + part)
        whole[free] = part
    state = np.empty(lanes, np.int16)
    now = IDLE
    for k, f in enumerate(whole.tolist()):
        state[k] = now
        now = f[now]
    out = np.empty((LANE, lanes), bool)
    for k, row in enumerate(code):
        at = row + state
        out[k] = begin.take(at)
        state = step.take(at)
    return out.T.reshape(-1)[:n]


def pieces(texts: list[str]) -> list[tuple[list[int], list[str]]]:
    """(start offsets, pieces) of each text; offsets are code points of the text."""
    sizes = [len(t) for t in texts]
    whole = "".join(texts)
    if not whole:
        return [([], []) for _ in texts]
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    begin = np.cumsum([0, *sizes])
    first[begin[:-1][np.array(sizes) > 0]] = True
    at = np.flatnonzero(starts(points, first))
    cuts = np.searchsorted(at, begin).tolist()
    marks = [*at.tolist(), len(whole)]
    out = []
    for k, base in enumerate(begin[:-1].tolist()):
        own = marks[cuts[k] : cuts[k + 1]]
        out.append(([x - base for x in own], [whole[a:b] for a, b in zip(own, [*own[1:], base + sizes[k]])]))
    return out


class Coder:
    """Ranks, memoised merging and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {str(v): k for k, v in ranks.items()}
        self.known = common.Memo(self.decimals, CACHE, SHORT_PIECE)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: merge the adjacent pair of lowest rank, the leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        return self.merge_long(piece) if len(piece) > SHORT_PIECE else self.merge_short(piece)

    def merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[x] for x in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n."""
        ranks, n = self.ranks, len(piece)
        end, prev, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            for k in (i, prev[i]):
                if k >= 0 and end[k] < n and (r := ranks.get(piece[k : end[end[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decimals(self, piece: str) -> str:
        """The piece's ids in decimal, joined by commas."""
        return ",".join(map(str, self.merge(piece.encode())))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[str]]]:
        """(start offsets, decimal ids) of each text's pieces."""
        ids = self.known.__getitem__
        return [(at, list(map(ids, own))) for at, own in pieces(texts)]

    def decode(self, decimals: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, decimals.split(","))) if decimals else b""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(load_ranks(path))


def groups(texts: list[str | None], most: int = CHUNK):
    """Consecutive stretches of texts of about `most` code points."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_column(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """docs' columns `keep` with n_tokens, ids, offsets (the code point at which each piece starts), piece_ids (the number
    of ids of each piece) and decoded (the bytes that the ids decode to)."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        code = coder(path)
        numbers = pa.list_(pa.int32())
        for batch in batches:
            joined, decoded, at, per = [], [], [], []
            for texts in groups(batch.column(len(keep)).to_pylist()):
                for begin, ids in code.encode(texts):
                    joined.append(",".join(ids))
                    decoded.append(code.decode(joined[-1]))
                    at.append(begin)
                    per.append([x.count(",") + 1 for x in ids])
            parts = pc.split_pattern(pa.array([x or None for x in joined], pa.string()), ",")
            ids = pc.fill_null(parts.cast(numbers), pa.scalar([], numbers))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64()), ids, pa.array(at, numbers), pa.array(per, numbers), pa.array(decoded, pa.binary())], names=[*keep, "n_tokens", "ids", "offsets", "piece_ids", "decoded"])
        code.known.old = {}  # an idle worker keeps one generation

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, n_tokens long, ids array<int>, offsets array<int>, piece_ids array<int>, decoded binary")


def decode_column(encoded: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """encoded's columns `keep` with the bytes that ids_col decodes to; null ids decode to nothing."""

    def run(batches):
        import pyarrow as pa

        table = {int(k): v for k, v in coder(path).bytes_of.items()}
        for batch in batches:
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """docs' columns `keep` with n_tokens, ids_sha256 and decoded_sha256 (of the bytes decoded from the ids)."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        code = coder(path)
        for batch in batches:
            n, a, b = [], [], []
            for texts in groups(batch.column(len(keep)).to_pylist()):
                for _, ids in code.encode(texts):
                    joined = ",".join(ids)
                    n.append(joined.count(",") + 1 if joined else 0)
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    b.append(hashlib.sha256(code.decode(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
        code.known.old = {}  # an idle worker keeps one generation

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode `documents` with the multilingual ranks and decode the ids."""
    docs = common.table(spark, sf_dir, "documents")
    return digests(docs, common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), ["doc_id"])
