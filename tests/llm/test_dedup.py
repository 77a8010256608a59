"""Near copies and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ngram_join, substring_dedup, suffix_groups


def texts():
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 6)))
    base = [[word() for _ in range(pick.randint(20, 120))] for _ in range(12)]
    out = [None, "", " \t\n ", "one two", "one two", "ONE two", "one  two", "one two three four", "a " * 3000]
    passage = [word() for _ in range(60)]
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(pick.randint(0, 3)):
            w[pick.randrange(len(w))] = word()
        if k % 5 == 0:
            w[3:3] = passage
        out.append(pick.choice([" ", "  "]).join(w))
    return out + out[20:30]


def truth(rows, shingle, per_cent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    reach = {d: {d} for d, _ in rows if d is not None}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                reach[a].add(b)
    least = {}
    for d in sorted(reach):
        if d not in least:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = d
                    todo += reach[x]
    return sets, least


@pytest.mark.parametrize("shingle,per_cent,chunk,spread", [(4, 85, 1 << 21, 256), (4, 85, 300, 256), (5, 80, 1 << 21, 2)])
def test_components(spark, monkeypatch, shingle, per_cent, chunk, spread):
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    rows = [(1000 - i, t) for i, t in enumerate([*texts(), " ".join(f"w{k}" for k in range(200_000))])]
    pick = random.Random(2)
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "key": F.lit("x"), "id": F.lit(0), "place": F.lit(1), "tokens": F.lit("t"), "counts": F.lit(2)}).repartition(4)
    got = ngram_join.components(df, shingle=shingle, per_cent=per_cent).collect()
    sets, least = truth(rows, shingle, per_cent)
    size = {d: len(s) for (d, _), s in zip(rows, sets)}
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (size[d], least[d]) for d, _ in rows}


def test_components_of_odd_rows(spark):
    long = "p q r s t u v w x y z"
    rows = [(5, long), (5, long), (7, "other words in this one here"), (5, "other words in this one here"), (9, long), (None, long), (None, "alone in the dark tonight"), (3, None)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == sorted([(5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (0, 5), (0, 0), (3, 3)])
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_find_every_component():
    draw = np.random.default_rng(1)
    number = lambda n: draw.integers(0, 1 << 40, n).astype(np.uint64)
    for per_cent in (85, 80, 100, 50) * 6:
        base = [np.unique(number(draw.integers(1, 60))) for _ in range(6)]
        sets = []
        for _ in range(60):
            b = base[draw.integers(6)]
            sets.append(np.unique(np.concatenate([b[draw.permutation(len(b))[draw.integers(0, len(b) // 6 + 1) :]], number(draw.integers(0, 4))])))
        links = lambda x, y: 100 * (k := len(np.intersect1d(x, y))) >= per_cent * (len(x) + len(y) - k)  # noqa: B023, E731
        chunk = ngram_join.Chunk(list(range(40)), sets[:40], per_cent)
        found = [{i} for i in range(40)]
        edges = chunk.inner()
        for a, b in edges:
            assert links(sets[a], sets[b])
            x, y = (next(c for c in found if i in c) for i in (a, b))
            assert x is not y  # a link for each union, no more
            found.remove(y)
            x |= y
        assert all(any({i, j} <= c for c in found) for i in range(40) for j in range(i) if links(sets[i], sets[j]))
        for x in sets[40:]:
            got = chunk.reached(x)
            reach = [c for c in found if any(links(x, sets[i]) for i in c)]
            assert all(links(x, sets[i]) for i in got) and sorted(min(c) for c in reach) == sorted(min(next(c for c in found if i in c)) for i in got)


def test_bounds_admit_every_link():
    draw = np.random.default_rng(2)
    core = draw.integers(0, 1 << 62, 90)
    sets = [np.unique(np.append(core[: draw.integers(60, 90)], draw.integers(0, 1 << 62, draw.integers(0, 60))).astype(np.uint64)) for _ in range(80)]
    bounds = ngram_join.Bounds(list(range(80)), [len(x) for x in sets], [ngram_join.bucket_counts(x).tobytes() for x in sets], 85)
    bounds.members()
    for i in range(80):
        if any(i != j and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k) for j in range(80)):
            assert bounds.open[i]
    assert not bounds.open.all()


def test_suffix_arrays():
    pick = random.Random(3)
    for _ in range(120):
        lanes = []
        for _ in range(pick.randint(1, 6)):
            a, n = pick.choice([1, 2, 3, 26]), pick.randint(0, 60)
            x = ([pick.randint(1, a) for _ in range(pick.randint(1, 5))] * 20)[:n] if pick.random() < 0.3 else [pick.randint(1, a) for _ in range(n)]
            lanes.append([*x, 0])
        sizes = np.array([len(x) for x in lanes])
        got, at = suffix_groups.suffix_arrays(np.array([c for x in lanes for c in x]), sizes), 0
        for x in lanes:
            assert (got[at : at + len(x)] - at).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
            at += len(x)


def test_neighbours_are_compared_as_bytes():
    pick = random.Random(5)
    raw = bytes(pick.choice(b"ab") for _ in range(400))
    words = substring_dedup.words_of(raw)
    a, b = np.array([pick.randrange(300) for _ in range(3000)]), np.array([pick.randrange(300) for _ in range(3000)])
    for size in (1, 3, 8, 9, 13, 40):
        assert substring_dedup.agree(words, a, b, size).tolist() == [raw[x : x + size] == raw[y : y + size] for x, y in zip(a.tolist(), b.tolist())]


def test_the_suffix_array_decides(monkeypatch):
    """With a wrong array nothing is found: no other step marks windows."""
    pick = random.Random(6)
    some = lambda n: bytes(pick.choice(b"abcdefgh") for _ in range(n))
    passage = some(60)
    groups = [[some(30) + passage + some(20), some(25) + passage + some(35), some(140)], [some(100), some(90)]]
    found = substring_dedup.repeated_windows(groups, [None, None], 40, 8)
    assert [[int(m.sum()) for m in g] for g in found] == [[21, 21, 0], [0, 0]]
    for broken in (lambda symbols, sizes: np.arange(len(symbols)), lambda symbols, sizes: np.argsort(np.arange(len(symbols)) * 7919 % 10007)):
        monkeypatch.setattr(substring_dedup, "suffix_arrays", broken)
        wrong = substring_dedup.repeated_windows(groups, [None, None], 40, 8)
        assert [[int(m.sum()) for m in g] for g in wrong] != [[21, 21, 0], [0, 0]]


def passages():
    pick = random.Random(7)
    some = lambda n: "".join(pick.choice("abcdé ") for _ in range(n))
    shared = [some(n) for n in (150, 199, 205, 260, 900)]
    out = [None, "", "short", "a" * 450, "ab" * 300, "x" * 199, "x" * 200]
    for k in range(70):
        out.append(some(pick.randint(0, 500)) + shared[k % 5] + some(pick.randint(0, 300)) + (shared[(k * 3) % 5] if k % 4 == 0 else ""))
    return out + [out[9], out[9], out[30][:400], "z" + out[31], "".join(pick.choice("abcdefghij") for _ in range(300_000)) + shared[4]]


@pytest.mark.parametrize("size,gram,split", [(200, 24, 256), (200, 24, 2), (40, 8, 3)])
def test_repeated_passages(spark, size, gram, split):
    rows = [(i, t) for i, t in enumerate(passages())]
    df = spark.createDataFrame([*rows, (4, rows[4][1]), (None, rows[12][1])], "doc_id long, text string").withColumns({"key": F.lit(1), "first": F.lit(2)}).repartition(4)
    everything = [(t or "").encode() for _, t in rows] + [rows[4][1].encode(), rows[12][1].encode()]
    counts = Counter(b[k : k + size] for b in everything for k in range(len(b) - size + 1))
    got = substring_dedup.dedup(df, size=size, gram=gram, split=split, kept=True).collect()
    assert len(got) == len(everything)
    for r in got:
        raw = everything[12 if r["doc_id"] is None else r["doc_id"]]
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - size + 1):
            if counts[raw[k : k + size]] > 1:
                gone[k : k + size] = True
        rest = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest)
    assert substring_dedup.dedup(df.limit(0), size=size, gram=gram).count() == 0
