"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte-wise: A-Z are lowered and every byte that isn't of a word becomes a space. The automaton is
over word numbers: it holds each distinct window of `window` item words (a shorter item is one window) and reads a text
once, as the numbers of its words (0 for words that no item has); hits come back as word ranges, mapped to byte and
character offsets of the original text.

What is sent are the items' words, not the windows. A worker's automaton has at most `window` nodes an item word, so
their number is bounded: items are cut into stretches of STRETCH words that overlap by window - 1 (their windows are the
item's), and beyond `most_nodes` the stretches are dealt by hash into several automata, applied one after the other; the
hits are united.

Rows: null or empty text = no words; items that are null or without words match nothing; repeated items all count; an
item whose id is null hits words, but isn't among the items that a document lists or counts. Texts are scanned whole.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WINDOW = 13
MOST_NODES = 6_000_000  # of one automaton: some 400 MB in a worker
STRETCH = 4096  # item words that are dealt together
#: Byte to byte: lower case, digits and bytes over 0x7F stay, A-Z are lowered, the rest is a space.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Machine:
    """The automaton of some stretches (item, words)."""

    def __init__(self, stretches: list[tuple], window: int = WINDOW):
        import ahocorasick

        found: dict[tuple, tuple[int, set]] = {}
        self.number: dict[bytes, int] = {}
        for item, w in stretches:
            own = [self.number.setdefault(x, len(self.number) + 1) for x in w]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = tuple(own[i : i + window])
                ids = found.setdefault(part, (len(part), set()))[1]
                if item is not None:
                    ids.add(item)
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, value in found.items():
                self.automaton.add_word(key, value)
            self.automaton.make_automaton()

    def hits(self, w: list[bytes]):
        """(end, (words, items)) of each window that occurs in a text's words."""
        if self.automaton is None or not w:
            return ()
        get = self.number.get
        own = tuple([get(x, 0) for x in w])
        return self.automaton.iter(own) if any(own) else ()


def scan(machine: Machine, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, hit word ranges, united and in order, ids of the items that occur)."""
    w = words(text)
    ids: set = set()
    ranges: list[tuple[int, int]] = []
    for last, (n, own) in machine.hits(w):
        ids |= own
        ranges.append((last - n + 1, last + 1))
    return len(w), unite(ranges, []), ids


def unite(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return [tuple(r) for r in out]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before a byte
    return [(int(chars[begin[a]]), int(chars[end[b - 1]])) for a, b in ranges]


#: A-Z lowered, then the words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lots(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, most_nodes: int = MOST_NODES):
    """Stretches (item, words) in lots of about most_nodes automaton nodes, each small enough for the driver."""
    found = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(WORD), 0)
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), found.alias("w")).where("size(w) > 0").distinct()
    begin = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)), F.lit(STRETCH))
    cut = items.select("item", F.explode(F.transform(begin, lambda i: F.slice("w", i, F.lit(STRETCH + window - 1)))).alias("w"))
    total = cut.agg(F.coalesce(F.sum(F.size("w").cast("long") * window), F.lit(0))).first()[0]
    n = max(1, -(-total // most_nodes))
    for k in range(n):
        own = cut if n == 1 else cut.where(F.pmod(F.xxhash64("item", "w"), F.lit(n)) == k)
        yield [(r["item"], [x.encode() for x in r["w"]]) for r in own.toLocalIterator()]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """docs with n_words, word_ranges, spans (characters) and items (sorted as strings). Every row stays, and every column
    but those of these four names."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop("n_words", "word_ranges", "spans", "items")
    fields = docs.schema.fields
    pairs = "array<struct<first:int,stop:int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", n_words long, word_ranges {pairs}, spans {pairs}, items array<string>"
    at = [f.name for f in fields].index(text_col)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "word_ranges": F.lit(None).cast(pairs), "spans": F.lit(None).cast(pairs), "items": F.array().cast("array<string>")})
    for lot in lots(benchmark, item_id, item_text, window, most_nodes):
        # A lot has most_nodes / window words or so; each task builds the automaton from it.
        held = spark.sparkContext.broadcast(lot)

        def run(batches, held=held):
            import pyarrow as pa

            machine = Machine(held.value, window)
            pair = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
            as_rows = lambda rs: [{"first": a, "stop": b} for a, b in rs]
            for batch in batches:
                n, ranges, spans, items = [], [], [], []
                own = batch.columns[: len(fields)]
                for text, seen, ids in zip(own[at].to_pylist(), batch.column(len(fields) + 1).to_pylist(), batch.column(len(fields) + 3).to_pylist()):
                    count, found, new = scan(machine, text)
                    found = unite(found, [(r["first"], r["stop"]) for r in seen or []])
                    n.append(count)
                    ranges.append(as_rows(found))
                    spans.append(as_rows(char_spans(text, found)) if found else [])
                    items.append(sorted(new.union(ids)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(ranges, pair), pa.array(spans, pair), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def contaminated() -> F.Column:
    """Over `find`'s columns: a twentieth of the words or more are hit."""
    hit = F.aggregate("word_ranges", F.lit(0), lambda a, r: a + r["stop"] - r["first"])
    return (hit > 0) & (F.lit(20).cast("long") * hit >= F.col("n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("word_ranges", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def strip_spans(text: F.Column, spans: F.Column) -> F.Column:
    """text without the character spans (which are in order and apart)."""
    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")), lambda a, s: F.struct(s["stop"].alias("at"), F.concat(a["kept"], F.array(F.substring(text, a["at"] + 1, s["first"] - a["at"]))).alias("kept")), lambda a: F.concat(F.array_join(a["kept"], ""), F.substring(text, a["at"] + 1, F.length(text) - a["at"])))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


__all__ = ["Machine", "char_spans", "contaminated", "find", "lots", "op4_decontaminate", "scan", "strip_spans", "words"]
