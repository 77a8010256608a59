"""Toxicity by noisy-channel deobfuscation.

A character language model (interpolated trigrams over all documents) and a channel (digits and signs that stand for
letters, separators between letters, repeated letters) turn each suspicious stretch of a text into a lattice; Viterbi
decoding restores the likeliest letters. The restored text is scored by a small linear model over words and word
beginnings.

Words cut into fragments by spaces (`mo ron`) are sought among the words that the scorer knows, and joined where the
language model finds the joined reading likelier.

The scorer learns from a bounded sample of labelled rows: TRAIN_PER_CLASS rows per class, by hash of the id, held-out
rows excluded. Language-model counts cover every document. Labels, language, source and id are never inputs of a score.

Rows: null or empty text has no words and gets the base score; a null id is never held out; rows repeated in `labels`
count once, toxic if any says so; null labels are skipped; of documents that share an id the one of the smallest text is
learnt from; without labels of both classes the score is 0. Texts and tokens of any length are decoded whole.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .decontaminate import FOLD

TRAIN_PER_CLASS = 4000  # labelled rows of each class that the scorer learns from
MIN_DOCS = 8  # positive documents a feature needs
PREFIXES = (4, 5, 6)
LONGEST_WORD = 40  # letters of a word that is learnt from letters set apart; in scoring, the longest feature counts
CACHE = 100_000  # tokens in one of the memo's two generations
THRESHOLD = 0.3

# ---- the character model ----

SIZE = 64  # symbols: 0 = not a letter, 1.. = the letters below, 63 = any other letter
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point of the first plane; upper case as lower."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            k = ALPHABET.find(ch.lower()) if len(ch.lower()) == 1 else -1
            out[c] = k + 1 if k >= 0 else SIZE - 1
    return out


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts over symbol triples, texts apart from each other."""
    points = np.frombuffer("\n\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le"), np.uint32)
    s = symbol_table()[np.minimum(points, 0xFFFF)].astype(np.int32)
    return np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log2 P(c | a, b) as an array [a, b, c]. At most SIZE**3 counts leave a task and reach the driver."""
    common.small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigram_counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return smooth(counts.reshape(SIZE, SIZE, SIZE))


def smooth(c3: np.ndarray) -> np.ndarray:
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2[None]) / (c3.sum(2, keepdims=True) + 4)
    return np.log2(p3).astype(np.float32)


# ---- the channel ----

# Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " .-_*~'"
COST_SIGN, COST_DROP, COST_REPEAT, COST_JOIN = 1.5, 1.0, 0.5, 6.0  # bits
COST_SPLIT = 2.0
COST_FRAGMENT = 6.0  # of a space inside a word
#: Trigrams alone seldom tell where words end. So a word's end that is less likely by up to this many bits may be one too:
#: the text has the likeliest reading, the features are those of each word that may lie between two such ends.
DOUBT = 4.0
LETTER, SIGN = "[^\\W\\d_]", "[0-9@$!|+€£(¡]"
#: A token to decode: a letter next to a sign, letters set apart by separators, a letter twice or more.
SUSPICIOUS = re.compile(rf"{LETTER}{SIGN}|{SIGN}{LETTER}|^\W*{LETTER}([.\-_*~'])(?:(?:{LETTER}|{SIGN})\1){{2,}}(?:{LETTER}|{SIGN})\W*$|({LETTER})\2")
#: Four or more single letters or signs, white space between each.
APART = re.compile(rf"(?<!\S)(?:(?:{LETTER}|{SIGN})\s+){{3,}}(?:{LETTER}|{SIGN})(?!\S)")
GAP = re.compile(r"\s+")


def runs(token: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for ch in token:
        if out and out[-1][0] == ch:
            out[-1] = (ch, out[-1][1] + 1)
        else:
            out.append((ch, 1))
    return out


def choices(ch: str, n: int, spaced: bool, doubled: bool, split: float) -> list[tuple[str, float]]:
    """(letters, cost) that the channel turns into n times ch. A separator may be nothing or the end of a word."""
    out: list[tuple[str, float]] = []
    if ch.isalpha():
        out = [(ch * n, 0.0)] if n < 3 else [(ch * 2, COST_REPEAT * 2)]
        if n > 1:
            out.append((ch, COST_REPEAT if n > 2 or doubled else COST_REPEAT * 16))
    for letter in SIGNS.get(ch, ""):
        out += [(letter, COST_SIGN * n)] if n != 2 else [(letter * 2, COST_SIGN * 2), (letter, COST_SIGN * 3)]
    if ch in SEPARATORS or not out:
        if spaced and ch in SEPARATORS:
            out += [("", 0.0), (ch, split)] if n < 2 else [("", COST_JOIN), (ch, 0.0)]
        else:
            out += [("", COST_DROP * n), (ch, COST_DROP)]
    elif ch in SIGNS:
        out.append(("", 14.0 * n))
    return out


def viterbi(token: str, model: np.ndarray, split: float = COST_SPLIT) -> str:
    """The likeliest letters behind a stretch (lower case), in time linear in its length."""
    spaced = len(token) > 2 and token[1] in SEPARATORS
    parts = runs(token)
    doubled = len(parts) > 2 and all(n > 1 for _, n in parts)
    table = symbol_table()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # what was said: (before, letters)
    for ch, n in parts:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for letters, cost in choices(ch, n, spaced, doubled, split):
            steps = [int(table[min(ord(letter), 0xFFFF)]) for letter in letters]
            for (a, b), (score, said) in best.items():
                x, y, s = a, b, score - cost
                for z in steps:
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (said, letters) if letters else said)
        best = new
    said = max(((score + float(model[a, b, 0]), said) for (a, b), (score, said) in best.items()), key=lambda x: x[0])[1]
    out: list[str] = []
    while said:
        said, letters = said
        out.append(letters)
    return "".join(reversed(out))


def possible_words(stretch: str, model: np.ndarray, longest: int = LONGEST_WORD) -> list[str]:
    """The words of up to `longest` letters that may lie in letters set apart by separators, and all the letters as one."""
    out: list[str] = []
    for said in words(viterbi(stretch, model, math.inf)):
        letters = said.decode(errors="replace")
        z = [0, 0, *symbol_table()[[min(ord(c), 0xFFFF) for c in letters]].tolist(), 0]
        p = lambda a, b, c: float(model[a, b, c])
        ends = [0]
        for k in range(1, len(letters)):  # an end before letter k, against none
            a, b, c, d = z[k : k + 4]
            if p(a, b, 0) + p(b, 0, c) + p(0, c, d) - p(a, b, c) - p(b, c, d) > -DOUBT:
                ends.append(k)
        ends.append(len(letters))
        for i, k in enumerate(ends):
            for j in ends[i + 1 : i + 1 + longest]:
                if j - k <= longest:
                    out.append(letters[k:j])
        out.append(letters)
    return out


def restored_token(token: str, model: np.ndarray) -> str:
    """A lower-case token, decoded if it is suspicious; punctuation at its ends stays outside the lattice."""
    core = token.strip(".,;:?!\"'()[]{}<>")
    return token.replace(core, viterbi(core, model), 1) if core and SUSPICIOUS.search(core) else token


def other_words(token: str, model: np.ndarray, longest: int = LONGEST_WORD) -> str:
    """What a token may be besides its restored form: itself, and the words of letters set apart."""
    core = token.strip(".,;:?!\"'()[]{}<>")
    return " ".join([token, *(possible_words(core, model, longest) if len(core) > 2 and core[1] in SEPARATORS and SUSPICIOUS.search(core) else ())])


def evened(m: re.Match) -> str:
    """A stretch of single letters with a space in each gap; two in gaps wider than its narrowest ones, which likely end a word."""
    gaps = GAP.findall(m[0])
    wide = [len(g) + 4 * ("\n" in g) for g in gaps]
    least = min(wide)
    marks = iter([" " if w == least else "  " for w in wide])
    return GAP.sub(lambda _: next(marks), m[0])


def tokens(text: str, model: np.ndarray, others: list[str] | None = None, longest: int = LONGEST_WORD) -> list[str]:
    """White-space tokens of the lower-cased text; letters set apart by white space are decoded into words. The words
    that may lie in them are added to `others`."""

    def decode(m: re.Match) -> str:
        stretch = evened(m)
        if others is not None:
            others.extend(possible_words(stretch, model, longest))
        return viterbi(stretch, model)

    return APART.sub(decode, text.lower()).split()


def restore(text: str | None, model: np.ndarray) -> str:
    """The restored text: decoded tokens, joined by spaces."""
    return " ".join(restored_token(t, model) for t in tokens(text or "", model))


def likelihood(text: str, model: np.ndarray) -> float:
    """log2 of the model's probability of a text between word ends."""
    z = [0, 0, *symbol_table()[[min(ord(c), 0xFFFF) for c in text]].tolist(), 0]
    return sum(float(model[a, b, c]) for a, b, c in zip(z, z[1:], z[2:]))


class Fragments:
    """Finds words of a list that spaces have cut in two or more."""

    def __init__(self, model: np.ndarray, whole: set[str]):
        self.model, self.whole = model, {w for w in whole if len(w) > 3}
        self.heads = {w[:k] for w in self.whole for k in range(1, len(w))}

    def find(self, own: list[str]) -> list[tuple[int, int, str]]:
        """(first, stop, word) of the tokens that are likelier one word than several."""
        out, heads = [], self.heads
        for i in [i for i, t in enumerate(own) if t in heads]:
            said = own[i]
            for j in range(i + 1, len(own)):
                end = own[j].rstrip(".,;:?!\"')]}")
                said += end
                if said in self.whole and likelihood(said, self.model) - COST_FRAGMENT > likelihood(" ".join([*own[i:j], end]), self.model):
                    out.append((i, j + 1, said))
                if said not in heads or end != own[j]:
                    break
        return out


# ---- the scorer ----


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(FOLD).split()


def marks(found: set[bytes]) -> set[str]:
    """Features of a set of words: the words and the beginnings of longer ones."""
    out = set()
    for w in (x.decode(errors="replace") for x in found):
        out.add(f"={w}")
        out.update(f"^{w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def text_marks(text: str | None, model: np.ndarray) -> set[str]:
    """Features of a text: of its tokens, decoded and as they are, and of words that may lie in letters set apart."""
    others: list[str] = []
    own = set(tokens(text or "", model, others)).union(others)
    return marks({w for t in own for w in words(f"{restored_token(t, model)} {other_words(t, model)}")})


def training_marks(docs: DataFrame, labels: DataFrame, model, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """Rows (doc, toxic, marks) of the training sample, one per different text."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = spark.createDataFrame([tuple(r) for part in picked for r in part.collect()], "doc_id long, toxic int")  # 2 x per_class rows at most
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [sorted(text_marks(t, model.value)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["doc", "toxic", "marks"])

    return chosen.groupBy(F.md5("text").alias("same")).agg(F.min("doc_id").alias("doc"), F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("doc", "toxic", "text").mapInArrow(run, "doc long, toxic int, marks array<string>")


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray, float, list[str]]:
    """(features, weights, bias, words that the features stand for) from training rows (doc, toxic, marks), a bounded sample."""
    sample = common.spool(sample, "toxic-marks")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return [], np.zeros(0), -99.0, []
    each = sample.select("doc", "toxic", F.explode("marks").alias("mark"))
    counted = each.groupBy("mark").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    share = F.col("p") / n1 - 4 * F.col("q") / n0
    least = min(MIN_DOCS, max(2, n1 // 10))
    kept = counted.where((F.col("p") >= least) & (share > 0)).select("mark")
    hits = each.join(kept, "mark").groupBy("mark").agg(F.collect_set("doc").alias("docs")).orderBy("mark").toArrow()  # of the sample's rows
    rows = sorted((r["doc"], r["toxic"]) for r in sample.select("doc", "toxic").collect())
    y = np.array([t for _, t in rows], float)
    marks_of, found = hits.column("mark").to_pylist(), hits.column("docs").combine_chunks()
    lists = np.asarray(found.offsets), np.searchsorted(np.array([d for d, _ in rows]), np.asarray(found.values))
    chosen = cover(marks_of, *lists, y, 4 * n1 / n0, least)
    x = np.zeros((len(y), len(chosen)))
    for k, m in enumerate(chosen):
        x[lists[1][lists[0][m] : lists[0][m + 1]], k] = 1
    w, b = logistic(x, y)
    features = [marks_of[m] for m in chosen]
    own = F.col("mark").isin(features)
    for k in PREFIXES:
        own = own | F.concat(F.lit("^"), F.substring("mark", 2, k)).isin(features)
    known = counted.where(F.col("mark").startswith("=") & own & (F.col("p") >= 2) & (share > 0)).select("mark").collect() if features else []
    return features, w, b, sorted(r["mark"][1:] for r in known)


def cover(names: list[str], begin: np.ndarray, docs: np.ndarray, y: np.ndarray, ratio: float, least: float) -> list[int]:
    """Greedy cover of the positives, negatives against: numbers of marks, whose rows are docs[begin[m]:begin[m + 1]], until
    none gains `least` more."""
    chosen: list[int] = []
    if not names:
        return chosen
    against = ratio * np.add.reduceat(1 - y[docs], begin[:-1])
    open_rows = y.copy()
    while True:
        gain = np.add.reduceat(open_rows[docs], begin[:-1]) - against
        gain[chosen] = -np.inf
        best = gain.max()
        if best < least:
            return chosen
        mark = max(np.flatnonzero(gain == best).tolist(), key=lambda m: (names[m][0] == "^", len(names[m]), names[m]))
        chosen.append(mark)
        open_rows[docs[begin[mark] : begin[mark + 1]]] = 0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(col: str) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Scorer:
    """Scores texts; each token's restored form and features are memoised."""

    def __init__(self, model: np.ndarray, features: list[str], weights: np.ndarray, bias: float, known_words: list[str] = ()):
        self.model, self.weights, self.bias = model, weights, bias
        self.place = {mark: k for k, mark in enumerate(features)}
        self.heads = {mark[1:5] for mark in features}  # no other beginning of a word has a feature
        self.longest = max([len(mark) - 1 for mark in features], default=1)
        self.fragments = Fragments(model, {*known_words, *(mark[1:] for mark in features if mark[0] == "=")})
        self.known = common.Memo(self.look, CACHE, 48)

    def look(self, token: str) -> tuple:
        """() for a token without features that stays as it is, else (restored token, its features)."""
        out = restored_token(token, self.model)
        known = {w for w in words(f"{out} {other_words(token, self.model, self.longest)}") if w.decode(errors="replace")[:4] in self.heads}
        own = tuple(sorted(k for m in marks(known) if (k := self.place.get(m)) is not None)) if known else ()
        return (out, own) if own or out != token else ()

    def score(self, text: str | None) -> tuple[float, list[str], int]:
        """(probability, restored tokens, number of tokens that aren't as they were)."""
        others: list[str] = []
        own = tokens(text or "", self.model, others, self.longest)
        seen = list(map(self.known.__getitem__, own))
        found = [x for x in seen if x] if any(seen) else []
        said = [x[0] if x else t for t, x in zip(own, seen)] if found else own
        joined = self.fragments.find(said)
        for _, _, word in joined:
            found.append(self.known[word])
        total = self.bias + sum(self.weights[k] for k in sorted({k for x in [*found, *map(self.known.__getitem__, set(others))] if x for k in x[1]}))
        changed = sum(a != b for a, b in zip(own, said)) + len(joined)
        if joined:
            said = list(said)
            for first, stop, word in reversed(joined):
                said[first:stop] = [word]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, total)))), said, changed


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS):
    """Everything a scorer needs: (language model, features, weights, bias, words)."""
    spark = docs.sparkSession
    model = language_model(docs)
    sent = spark.sparkContext.broadcast(model)  # SIZE**3 numbers
    return (model, *fit(training_marks(docs, labels, sent, per_class)))


def score(docs: DataFrame, learned, text_col: str = "text", restored: bool = False) -> DataFrame:
    """docs with score, n_restored and optionally `restored`, the restored text. Every row stays, and every column but
    those of these names."""
    spark = docs.sparkSession
    docs = docs.drop("score", "n_restored", "restored")
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(learned)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*shared.value)
        for batch in batches:
            got = [scorer.score(t) for t in batch.column(at).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())]
            if restored:
                cols.append(pa.array([" ".join(g[1]) for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, "score", "n_restored", *["restored"] * restored])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, n_restored long" + ", restored string" * restored)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored")
