"""Token-id files under a canonical length-limited Huffman code.

The code comes from the global id counts. A file is a sequence of independent blocks; a block holds a bit stream, a
bit-offset checkpoint every `STEP` ids and the documents' ids and lengths, so any stretch decodes from its nearest
checkpoint. Decoding looks up `LIMIT` bits at a time in one table, for all checkpoints of a block in lockstep.

Rows: null or empty text = the end id alone; repeated rows are written each; rows that share a doc_id come in order of a
hash of their ids; rows with a null doc_id come first. An empty table gives no files and no rows. Extra columns are
ignored. A text is encoded whole, however long.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

MAGIC = b"LFH1"
LIMIT = 18  # longest code, bits
STEP = 256  # ids between checkpoints
BLOCK_IDS = 1 << 19
FILE_IDS = 1 << 26
GROUP_BYTES = 4 << 20  # text whose chunks are numbered at once
LONG = 4096  # characters from which the library takes a chunk as it is
CACHE = 750_000  # chunks in one of the memo's two generations, per worker; a third as many pieces
END_ID = 2


# ---- the code ----


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels, merged, origin = [], weight, np.arange(n)
    for _ in range(limit - 1):
        levels.append(origin)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, packages])
        place = np.argsort(both, kind="stable")
        merged, origin = both[place], np.where(place < n, place, -1)
    levels.append(origin)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for origin in reversed(levels):  # from the last level: packages taken there take twice as many below
        taken = origin[:take]
        leaves = taken[taken >= 0]
        length[leaves] += 1
        take = 2 * int((taken < 0).sum())
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    code, last = 0, 0
    for i in ids.tolist():
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every LIMIT-bit window."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    span = 1 << (LIMIT - lengths[ids].astype(np.int64))
    pad = (1 << LIMIT) - int(span.sum())
    return np.concatenate([np.repeat(ids, span), np.zeros(pad, np.int64)]).astype(np.uint32), np.concatenate([np.repeat(lengths[ids], span), np.zeros(pad, np.uint8)])


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every STEP-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word, shift = at >> 6, (64 - (at & 63) - size)
    code = codes[ids]
    high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out[: (int(end[-1]) + 63) // 64].astype(">u8").tobytes(), at[::STEP].astype(np.uint32)


def unpack(stream: bytes, checks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block: one lane for each checkpoint, STEP lookups in lockstep."""
    symbols, sizes = table
    raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte
    at = checks.astype(np.int64)
    last = len(window) - 1
    out = np.zeros((STEP, len(at)), np.uint32)
    for k in range(STEP):
        look = (window[np.minimum(at >> 3, last)] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[k] = symbols[look]
        at += sizes[look]
    return out.T.reshape(-1)[:n]


# ---- blocks ----


def write_block(out, doc_ids: list, counts: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> int:
    stream, checks = pack(ids, lengths, codes)
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    head = struct.pack("<IIIQ", len(doc_ids), len(ids), len(checks), len(stream))
    parts = [MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known, np.array(counts, "<u4").tobytes(), checks.astype("<u4").tobytes(), stream]
    return sum(out.write(p) for p in parts)


def read_block(source, table) -> tuple[list, np.ndarray, np.ndarray] | None:
    """(doc ids, ids of each, all ids) or None at the end."""
    if source.read(4) != MAGIC:
        return None
    docs, n, checks, size = struct.unpack("<IIIQ", source.read(20))
    names = np.frombuffer(source.read(8 * docs), "<i8").tolist()
    known = source.read(docs)
    counts = np.frombuffer(source.read(4 * docs), "<u4")
    marks = np.frombuffer(source.read(4 * checks), "<u4")
    return [d if k else None for d, k in zip(names, known)], counts, unpack(source.read(size), marks, n, table)


# ---- encoding texts with the tokenizers library ----

#: The pieces of the byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose classes have been the same in all Unicode versions in use; chunks with others go through the library.
SETTLED = re.compile("[\0-\u024f\u2010-\u2027]*")
#: Byte to character, as byte-level vocabularies spell it: printable Latin-1 stays, the rest follows from U+0100 on.
SPELLED = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else 0 for b in range(256)}
SPELLED |= {b: 256 + k for k, b in enumerate(b for b in range(256) if not SPELLED[b])}
SPACE = chr(SPELLED[32])


#: A chunk that is one piece; one that the texts around it don't change, a single newline or with no white space at an end.
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
CLEAN = re.compile(r" ?\S(?:.*\S)?|\n", re.DOTALL)
#: What a byte is to the cuts: 1 a letter, 2 an ASCII sign, 3 the first byte of two (U+00C0 to U+00FF), 4 a digit, 0 anything else.
KIND = np.array([0 if not 33 <= b <= 126 else 1 if chr(b).isalpha() else 4 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)
KIND[0xC3] = 3


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte of a UTF-8 text: at spaces, at signs that follow a letter, at a newline between
    two bytes that surely aren't white space, and after it."""
    kind = KIND[raw]
    letter = kind == 1
    letter[1:] |= (kind[:-1] == 3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # two-byte signs: U+00D7, U+00F7
    out = raw == 32
    out[1:] |= letter[:-1] & (kind[1:] == 2)
    line = np.flatnonzero(raw[1:-1] == 10) + 1
    line = line[((kind[line - 1] > 0) | letter[line - 1]) & (kind[line + 1] > 0)]
    out[line] = out[line + 1] = True
    return out


class ChunkEncoder:
    """Library encodings of whole texts, assembled from memoised chunks.

    A text is cut before each single space, where a sign follows a letter, and around a single newline. Byte-level
    pre-tokenisation has a boundary at each such place, looks ahead from a boundary but never back, and merges pieces
    independently, so the chunks' ids joined are the text's ids. New chunks are cut into the pre-tokenizer's pieces, and
    new pieces merged by the library's model; those that are long or of unsettled characters are encoded by it. Where a cut falls inside a run of white space, or the text has the string of
    an added token, which the library takes whole, the whole text goes through the library; so does every text if the
    tokenizer isn't a plain byte-level one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        kind = json.loads(self.lib.to_str())
        before = kind["pre_tokenizer"] or {}
        self.plain = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and kind["model"]["type"] == "BPE" and kind["post_processor"] is None
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.merge = self.lib.model.tokenize
        self.pieces = common.Memo(self.merged, CACHE // 3, 48)
        self.chunks = common.Memo(self.learn, CACHE, 48)

    def library(self, text: str) -> bytes:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16).tobytes()

    def merged(self, piece: str) -> bytes:
        spelled = SPACE + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isprintable() else piece.encode().decode("latin-1").translate(SPELLED)
        return array("H", [t.id for t in self.merge(spelled)]).tobytes()

    def learn(self, chunk: str) -> bytes:
        """The ids of a new chunk."""
        if WORD.fullmatch(chunk):
            return self.merged(chunk)
        if len(chunk) > LONG or not SETTLED.fullmatch(chunk):
            return self.library(chunk)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk)))

    def known(self, words: list[str], uses: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> list[bytes]:
        """The ids of distinct chunks; the texts have counts[k] chunks each, numbered in `uses`. Sets `odd` for texts with
        a chunk that white space around it may change; what only odd texts have isn't learnt, and empty here."""
        found = list(map(self.chunks.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        old = self.chunks.old
        bad = [k for k in new if not ((x := words[k]) in old or WORD.fullmatch(x) or CLEAN.fullmatch(x))]
        if bad or odd.any():
            owner = np.repeat(np.arange(len(counts)), counts)
            mark = np.zeros(len(words), bool)
            mark[bad] = True
            odd[owner[mark[uses]]] = True
            wanted = np.zeros(len(words), bool)
            wanted[uses[~odd[owner]]] = True
            for k in new:
                found[k] = b""
            new = [k for k in new if wanted[k]]
        for k in new:
            found[k] = self.chunks[words[k]]
        return found

    def encode_all(self, texts, end: bytes = b""):
        """Ids of each text of an Arrow array (null: none), then `end`, as an array of little-endian 16-bit integers.
        The chunks of all texts are numbered by Arrow, and only distinct ones are looked up."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.string()).fill_null("")
        n = len(texts)
        odd = np.full(n, not self.plain)
        for x in self.added:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        found, uses = [], np.zeros(0, np.int32)
        first = np.zeros(n + 1, np.int64)  # number of chunks before each text
        if at[-1] > at[0]:
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
            starts = cuts(raw)
            starts[(at - at[0])[:-1][np.diff(at) > 0]] = True
            places = np.append(np.flatnonzero(starts), len(raw))
            first = np.searchsorted(places, at - at[0])
            chunks = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
            uses = chunks.indices.to_numpy()
            size = len(chunks.dictionary)
            words = pc.binary_join(pa.ListArray.from_arrays([0, size], chunks.dictionary), "\1")[0].as_py().split("\1")
            found = self.known(words if len(words) == size else chunks.dictionary.to_pylist(), uses, np.diff(first), odd)
        # A text is its chunks, or a whole from the library in place of the first; then the end.
        whole = {k: self.library(texts[k].as_py()) for k in np.flatnonzero(odd).tolist()}
        last, none = len(found), len(found) + 1
        order = np.full(len(uses) + n, last, np.int64)
        begin = first + np.arange(n + 1)
        chunk = np.ones(len(order), bool)
        chunk[begin[1:] - 1] = False
        order[chunk] = uses
        for j, k in enumerate(whole):
            order[begin[k] : begin[k + 1] - 1] = none
            order[begin[k] : begin[k + 1] - 1][:1] = none + 1 + j
        out = pa.array([*found, end, b"", *whole.values()], pa.binary()).take(pa.array(order))
        marks = np.frombuffer(out.buffers()[1], np.int32)[begin]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(marks), out.buffers()[2]])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 16-bit integers."""
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Rows (id, n, ids): the ids of each whole text with the end id, as packed 16-bit integers."""
    common.small_batches(docs.sparkSession)
    end = np.array([end_id], np.uint16).tobytes()

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path)

        def coded(held):
            ids = enc.encode_all(pa.concat_arrays([b.column(1) for b in held]), end)
            n = np.diff(np.frombuffer(ids.buffers()[1], np.int32)) // 2
            return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0) for b in held]), pa.array(n, pa.int64()), ids], names=["id", "n", "ids"])

        def parts(batch):
            if batch.num_rows < 2 or batch.column(1).nbytes <= GROUP_BYTES:
                return [batch] if batch.num_rows else []
            half = batch.num_rows // 2
            return parts(batch.slice(0, half)) + parts(batch.slice(half))

        held, size = [], 0
        for batch in batches:
            for part in parts(batch):
                held.append(part)
                size += part.column(1).nbytes
                if size >= GROUP_BYTES:
                    yield coded(held)
                    held, size = [], 0
        if held:
            yield coded(held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Global count of each id. At most `vocabulary` rows leave each task and reach the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["t", "n"])

    rows = tokens.select("ids").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["t"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_files(tokens: DataFrame, out: str, lengths: np.ndarray, total: int = 0) -> DataFrame:
    """Write tokens (id, n, ids) in ascending id order, a file for each range of ids, about FILE_IDS of `total` ids at most;
    rows (part, file, n, n_docs)."""
    spark = tokens.sparkSession
    common.ensure_dir(spark, out)
    codes = canonical(lengths)
    shared = spark.sparkContext.broadcast((lengths, codes))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, (lengths, codes) = TaskContext.get(), shared.value
        fs, root = common.open_fs(out)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.lfh"
        sink, total, docs = None, 0, 0
        held, names, counts, size = [], [], [], 0

        def flush():
            nonlocal sink, held, names, counts, size
            if names:
                sink = sink or fs.open_output_stream(f"{root}/{name}", compression=None)
                write_block(sink, names, counts, np.concatenate(held), lengths, codes)
                held, names, counts, size = [], [], [], 0

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, np.uint16)
                held.append(ids)
                names.append(doc)
                counts.append(len(ids))
                size += len(ids)
                total, docs = total + len(ids), docs + 1
                if size >= BLOCK_IDS:
                    flush()
        flush()
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([f"{out}/{name}"]), pa.array([total]), pa.array([docs])], names=["part", "file", "n", "n_docs"])

    order = [F.col("id").asc_nulls_first(), F.col("tie")]  # rows that share an id can lie in several files
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_IDS))
    ordered = tokens.select("id", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.spool(ordered.mapInArrow(write, "part long, file string, n long, n_docs long"), "token-index")


def read_files(spark: SparkSession, index: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, file, first_in_file) from the files, in their order.

    A file's first position is the running sum over the index, which has one row per file.
    """
    shared = spark.sparkContext.broadcast(lengths)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = index.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def read(batches):
        import pyarrow as pa

        table = decode_table(shared.value)
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = common.open_fs(uri)
                at = base
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                    while (block := read_block(source, table)) is not None:
                        docs, counts, ids = block
                        raw = memoryview(ids.astype("<u4").tobytes())
                        ends = np.cumsum(counts.astype(np.int64))
                        begins = ends - counts
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + at), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([uri] * len(docs)), pa.array(begins + at - base)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "first_in_file"])
                        at += int(ends[-1])

    spread = starts.repartition(max(1, min(index.count(), 1 << 20)), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, first_in_file long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode `documents`, write the coded files, read them back."""
    path = common.tokenizer_path("byte_bpe_50k.json")
    tokens = common.spool(tokenize(common.table(spark, sf_dir, "documents"), path), "tokens")
    counts = id_counts(tokens, 1 << 16)
    lengths = code_lengths(counts)
    index = write_files(tokens, common.shared_dir(spark, "token-files"), lengths, int(counts.sum()))
    common.drop_spool(tokens)
    return read_files(spark, index, lengths)
