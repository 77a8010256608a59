"""Suffix-array removal of repeated passages: every byte covered by a string of `size` bytes that also starts elsewhere.

Windows of `size` bytes are dealt by anchors: a window's anchor is the smallest hash among its `gram`-byte strings (the
leftmost of equals). Equal windows have equal anchors at equal places, so a window's copies are all under its anchor.
Consecutive windows with one anchor form a run; a run's bytes are its context.

1. Runs are counted by (anchor, context); both are 64-bit hashes, so runs of equal bytes collapse into one. A context
   that occurs twice is repeated as a whole; an anchor with one occurrence has nothing to compare. Only anchors with
   several different contexts stay open.
2. One occurrence of each context of an open anchor brings its bytes. Every window holds the anchor and the bytes before
   it, or those after it, up to half of the rest; contexts that share neither with another one are set aside. The others
   are a lane of a suffix array, built by linear grouping in lockstep over many anchors (suffix_groups). Neighbours in the
   array that agree in `size` bytes, compared as bytes, are repeated.
3. An anchor with more than `split` contexts isn't gathered. Its runs are cut into blocks of BLOCK starts, aligned at the
   anchor. A block that occurs twice is repeated as a whole; a block whose core (the bytes that all its windows share)
   occurs once has nothing to compare; the windows of the others are dealt one by one, by their hashes, and two of each
   hash are a lane of a suffix array, which decides for all.

Hashes collapse copies and deal candidates; that different contexts repeat each other is found in suffix arrays alone.
All counts are aggregated before they are shuffled. Matches are judged on the input; they never cross documents.

Rows: null or empty text has no bytes and no spans; texts shorter than `size` keep all; repeated rows repeat each other.
Extra columns are ignored. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, rolling
from .suffix_groups import ranges, suffix_arrays

SIZE, GRAM = 200, 24
SPLIT = 256  # different contexts that an anchor's suffix array may have
BLOCK = 16  # starts in a block of a split anchor
BATCH_SYMBOLS = 1 << 20  # symbols that suffix arrays are built over at once
LOW = np.uint64(0xFFFFFFFF)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each x[i:i+width]: block-wise running minima from both ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(raw: bytes, size: int = SIZE, gram: int = GRAM):
    """(anchor, context, first, last): each run of windows' anchor hash, context hash, first and last start."""
    if len(raw) < size:
        return None
    sums = rolling.prefix_sums(raw)
    hashes = rolling.windows(sums, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    best = window_minima((hashes & ~LOW) | (place & LOW), size - gram + 1)
    at = (best & LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    anchor = hashes[at[first]]
    context = rolling.substrings(sums, first, last + size) ^ rolling.mix((at[first] - first).astype(np.uint64))
    return anchor, context, first, last


def all_runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Rows (id, key, anchor, context, first, last) of every run of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, keys, parts, counts = batch.column(0), batch.column(1), [], []
            for text in batch.column(2).to_pylist():
                found = runs((text or "").encode(), size, gram)
                counts.append(0 if found is None else len(found[0]))
                if found is not None:
                    parts.append(found)
            if not parts:
                continue
            anchor, context, first, last = (np.concatenate(c) for c in zip(*parts))
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["id", "key", "anchor", "context", "first", "last"])

    return docs.mapInArrow(run, "id long, key long, anchor long, context long, first int, last int")


def twins(raw: bytes, begin: np.ndarray, end: np.ndarray, group: np.ndarray, anchor: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Which contexts raw[begin:end] share their anchor and `side` bytes before it, or the rest of a window after it, with
    another one of their group. Windows that do neither can't be equal."""
    sums = rolling.prefix_sums(raw)
    grams = rolling.windows(sums, gram)
    lengths = end - begin
    at = ranges(begin, lengths - gram + 1)
    hit = np.flatnonzero(grams[at] == np.repeat(anchor, lengths - gram + 1))
    first = hit[np.searchsorted(hit, np.cumsum(lengths - gram + 1) - (lengths - gram + 1))]
    p = at[first]  # the leftmost occurrence is the anchor
    side = (size - gram) // 2
    out = np.zeros(len(begin), bool)
    for has, a, b in ((p - begin >= side, p - side, p + gram), (p - (end - size) <= side, p, p + size - side)):
        own = np.flatnonzero(has)
        if len(own) > 1:
            key = rolling.substrings(sums, a[own], b[own])
            order = np.lexsort((key, group[own]))
            same = (key[order][1:] == key[order][:-1]) & (group[own][order][1:] == group[own][order][:-1])
            out[own[order[1:][same]]] = True
            out[own[order[:-1][same]]] = True
    return out


def words_of(raw: bytes) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    x = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) + 1, np.uint64)
    for k in range(8):
        out |= x[k : k + len(out)] << np.uint64(8 * k)
    return out


def agree(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Do the `size` bytes from a and from b agree?"""
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in [*range(0, size - 7, 8), size - 8] if size >= 8 else []:
        live = live[words[a[live] + k] == words[b[live] + k]]
    if size < 8:
        mask = np.uint64((1 << 8 * size) - 1)
        live = live[(words[a] & mask) == (words[b] & mask)]
    out[:] = False
    out[live] = True
    return out


def repeated_windows(groups: list[list[bytes]], anchors: list[int | None], size: int = SIZE, gram: int = GRAM) -> list[list[np.ndarray]]:
    """For each group of contexts, which window starts of each are repeated in the group: by suffix arrays. A group without
    an anchor is taken as it is."""
    flat = [c for g in groups for c in g]
    lengths = np.array([len(c) for c in flat])
    raw = b"".join(flat)
    begin = np.cumsum(lengths) - lengths
    sizes = [len(g) for g in groups]
    group = np.repeat(np.arange(len(groups)), sizes)
    plain = np.repeat([a is None for a in anchors], sizes)
    kept = plain.copy()
    own = np.flatnonzero(~plain)
    if len(own):
        anchor = np.repeat(np.array([a or 0 for a in anchors], np.int64).view(np.uint64), sizes)[own]
        kept[own] = twins(raw, begin[own], begin[own] + lengths[own], group[own], anchor, size, gram)
    found = np.zeros(len(raw), bool)
    kept = np.flatnonzero(kept)
    if len(kept):
        left, piece, lane = begin[kept], lengths[kept], group[kept]
        # A lane is its contexts, each closed by a symbol of its own; the last of a lane is the smallest.
        total = piece + 1
        whole = np.zeros(int(total.sum()), np.int64)
        stop = np.cumsum(total)
        body = ranges(stop - total, piece)
        source = ranges(left, piece)
        per_lane = np.bincount(lane, minlength=len(groups))
        lanes = np.flatnonzero(per_lane)
        index = np.arange(len(kept)) - np.repeat(np.cumsum(per_lane[lanes]) - per_lane[lanes], per_lane[lanes])
        whole[stop - 1] = np.repeat(per_lane[lanes], per_lane[lanes]) - 1 - index
        whole[body] = np.frombuffer(raw, np.uint8)[source].astype(np.int64) + len(kept)
        lane_sizes = np.bincount(lane, weights=total, minlength=len(groups))[lanes].astype(np.int64)
        array = suffix_arrays(whole, lane_sizes)
        origin = np.full(len(whole), -1, np.int64)  # where a symbol came from, if a window starts there
        room = np.repeat(left + piece, piece) - source >= size
        origin[body[room]] = source[room]
        a, b = origin[array[:-1]], origin[array[1:]]
        lane_of = np.repeat(np.arange(len(lanes)), lane_sizes)[array]
        near = np.flatnonzero((a >= 0) & (b >= 0) & (lane_of[1:] == lane_of[:-1]))
        near = near[agree(words_of(raw), a[near], b[near], size)]
        found[a[near]] = True
        found[b[near]] = True
    out, k = [], 0
    for g in groups:
        out.append([found[begin[k + i] : begin[k + i] + lengths[k + i] - size + 1] for i in range(len(g))])
        k += len(g)
    return out


def spans_of(mask: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Byte spans covered by the windows that start where mask is set; overlapping and touching ones united."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size)
    return [(int(a), int(b) + size) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


SPANS = "array<struct<a:int,b:int>>"


def by_suffix_arrays(contexts: DataFrame, size: int, gram: int) -> DataFrame:
    """Rows (lane, name, spans) from (lane, name, anchor, bytes): a lane's texts come in order, `split` at most."""

    def run(batches):
        import pyarrow as pa

        pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        waiting: dict[int, tuple[int, list]] = {}  # groups by the binary order of their size, so that lanes are alike
        place, at, names, texts = None, None, [], []

        def solve(lot):
            rows = []
            for (lane, _, own, _), masks in zip(lot, repeated_windows([x[3] for x in lot], [x[1] for x in lot], size, gram)):
                rows += [(lane, c, [{"a": a, "b": b} for a, b in spans_of(m, size)]) for c, m in zip(own, masks) if m.any()]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pair)], names=["lane", "name", "spans"])

        def close():
            if len(texts) > 1:
                bits = sum(map(len, texts)).bit_length()
                n, lot = waiting.get(bits, (0, []))
                lot.append((place, at, names, texts))
                waiting[bits] = n + sum(map(len, texts)), lot
                if waiting[bits][0] >= BATCH_SYMBOLS:
                    return waiting.pop(bits)[1]
            return None

        for batch in batches:
            for lane, name, anchor, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if lane != place:
                    if lot := close():
                        yield solve(lot)
                    place, at, names, texts = lane, anchor, [], []
                if not names or names[-1] != name:
                    names.append(name)
                    texts.append(raw)
        if lot := close():
            yield solve(lot)
        for _, lot in waiting.values():
            yield solve(lot)

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = contexts.select("lane", "name", "anchor", "bytes").repartition(parts, "lane").sortWithinPartitions("lane", "name")
    return rows.mapInArrow(run, f"lane long, name long, spans {SPANS}")


def blocks_of(raw: bytes, sums: np.ndarray, grams: np.ndarray, anchor: int, first: int, last: int, size: int) -> list[tuple]:
    """The blocks of a run: bytes, number, core hash, hash, offset of the first start in the run."""
    p = first + int(np.flatnonzero(grams[first : first + size] == np.int64(anchor).view(np.uint64))[0])
    low = first
    out = []
    while low <= last:
        b = (low - p) // BLOCK
        high = min(last, p + BLOCK * b + BLOCK - 1)
        base = p + BLOCK * b
        core, block = rolling.substrings(sums, np.array([base + BLOCK - 1, low]), np.array([base + size, high + size])).view(np.int64).tolist()
        out.append((raw[low : high + size], b, core, block ^ (low - base), low - first))
        low = high + 1
    return out


def by_windows(each: DataFrame, size: int, gram: int) -> DataFrame:
    """Rows (anchor, context, spans) from the blocks (anchor, context, times, bytes, b, core, block, at) of anchors that have
    too many contexts to gather."""
    at = ["anchor", "b", "core"]
    kinds = each.groupBy(*at, "block").agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes"))
    cores = kinds.groupBy(*at).agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1").select(*at, "kinds")
    kinds = common.spool(kinds.join(cores, at), "blocks")
    whole = kinds.where("times > 1").select(*at, "block", F.array(F.struct(F.lit(0).alias("a"), F.length("bytes").alias("b"))).alias("spans"))
    window = F.substring("bytes", F.col("i") + 1, F.lit(size))
    windows = kinds.where("kinds > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.length("bytes") - size))).select(*at, "block", "times", "i", F.xxhash64(window).alias("hash"))
    windows = common.spool(windows, "windows")  # read twice
    # Two windows of each hash are a lane: the array says whether they are equal.
    dealt = windows.groupBy(*at, "hash").agg(F.count("*").alias("n"), F.min(F.struct("block", "i")).alias("low"), F.max(F.struct("block", "i")).alias("high")).where("n > 1")
    dealt = common.spool(dealt.withColumn("lane", F.xxhash64(*at, "hash")), "window-lanes")
    two = dealt.select("lane", *at, F.explode(F.array("low", "high")).alias("r")).select("lane", *at, "r.block", "r.i").join(kinds.select(*at, "block", "bytes"), [*at, "block"])
    equal = by_suffix_arrays(two.select("lane", F.col("block").alias("name"), F.lit(None).cast("long").alias("anchor"), window.alias("bytes")), size, gram).select("lane").distinct()
    again = dealt.join(equal, "lane").select(*at, "hash")
    hits = windows.where("times = 1").join(again, [*at, "hash"]).groupBy(*at, "block").agg(F.collect_list("i").alias("i"))
    hits = hits.select(*at, "block", F.transform("i", lambda s: F.struct(s.alias("a"), (s + size).alias("b"))).alias("spans"))
    found = each.select("anchor", "context", "b", "core", "block", "at").join(whole.union(hits), [*at, "block"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    return found.select("anchor", "context", moved.alias("spans")).groupBy("anchor", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def fetch(docs: DataFrame, wanted: DataFrame, size: int, gram: int, split: int) -> DataFrame:
    """Of the wanted runs (id, key, runs: array of structs): a row with the bytes, or for anchors beyond `split` a row for
    each block."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("times", pa.int64()), ("bytes", pa.binary()), ("b", pa.int32()), ("core", pa.int64()), ("block", pa.int64()), ("at", pa.int32())])
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                sums = None
                for r in own:
                    head = (r["anchor"], r["context"], r["n"])
                    if r["contexts"] <= split:
                        rows.append((*head, raw[r["first"] : r["last"] + size], None, None, None, None))
                        continue
                    if sums is None:
                        sums = rolling.prefix_sums(raw)
                        grams = rolling.windows(sums, gram)
                    rows += [(*head, *x) for x in blocks_of(raw, sums, grams, r["anchor"], r["first"], r["last"], size)]
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.join(wanted, ["id", "key"]).select("text", "runs").mapInArrow(run, "anchor long, context long, times long, bytes binary, b int, core long, block long, at int")


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """Rows (id, key, spans) of the documents (id, key, text) that have repeated bytes; spans may overlap. A spooled table;
    working tables are deleted."""
    with common.scope(docs.sparkSession):
        return common.keep(common.spool(found_spans(docs, size, gram, split), "spans"))


def found_spans(docs: DataFrame, size: int, gram: int, split: int) -> DataFrame:
    spark = docs.sparkSession
    found = common.spool(all_runs(docs, size, gram), "runs")
    contexts = found.groupBy("anchor", "context").agg(F.count("*").alias("n"))
    anchors = contexts.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("contexts")).where("all > 1").select("anchor", "contexts")
    live = contexts.join(anchors, "anchor")
    places = common.spool(found.join(live, ["anchor", "context"]), "live-runs")
    common.drop_spool(found)
    common.free_shuffles(spark)

    several = places.where("contexts > 1")
    one_each = several.groupBy("anchor", "context").agg(F.min(F.struct("id", "key", "first", "last", "n", "contexts")).alias("r"))
    wanted = one_each.select("r.id", "r.key", F.struct("anchor", "context", "r.first", "r.last", "r.n", "r.contexts").alias("run")).groupBy("id", "key").agg(F.collect_list("run").alias("runs"))
    got = common.spool(fetch(docs, wanted, size, gram, split), "contexts")
    common.free_shuffles(spark)
    lanes = got.where("b is null").select(F.col("anchor").alias("lane"), F.col("context").alias("name"), "anchor", "bytes")
    parts = by_suffix_arrays(lanes, size, gram).toDF("anchor", "context", "spans").union(by_windows(got.where("b is not null"), size, gram))
    parts = common.spool(parts, "parts")
    common.drop_spool(got)
    common.free_shuffles(spark)

    whole = places.where("n > 1").select("id", "key", F.array(F.struct(F.col("first").alias("a"), (F.col("last") + size).alias("b"))).alias("spans"))
    partly = places.where("n = 1 and contexts > 1").join(parts, ["anchor", "context"])
    partly = partly.select("id", "key", F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b"))).alias("spans"))
    return whole.union(partly).groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, split: int = SPLIT, kept: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with `kept` also the removed spans and the kept bytes."""
    spark = documents.sparkSession
    common.small_batches(spark)
    lowest = -(1 << 63)
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs.select("id", "key", "text"), size, gram, split)
    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, cut = (text or "").encode(), united(found)
                rest = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)])) if cut else raw
                rows.append((len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": b} for a, b in cut], rest if kept else None))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 if kept else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k, _ in zip(cols, kinds, names))], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", spans {SPANS}, kept binary" * kept
    return own.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
