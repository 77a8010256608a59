"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word shingles. Equal sets collapse into one. Similar sets are partitioned into groups by
the shared prefix token that most sets have; the matrix says which tokens occur in which group's prefixes, so a set
finds the groups that may hold a partner by joining its prefix tokens with the matrix, never with other sets. Large groups
are dealt into chunks of bounded size, each with its own rows of the matrix. A chunk keeps its token union as counts over
BUCKETS hash buckets of tokens (the largest count that a member has), with each member's counts; bucket by bucket, what a
set can share with a member is at most the smaller count. Only sets whose bound reaches the threshold with some member,
and the members so reached, are opened: their tokens are read and compared exactly.

Prefix rule, in any fixed order of tokens: of a set of n tokens, a partner shares `l` of the first n - ceil(0.85 n) + l;
if the partner isn't smaller, `l` of the first n - ceil(2 * 0.85 / 1.85 n) + l, and only these enter the matrix. So the
larger set of a pair finds the smaller one's group, by l tokens at least. The order puts tokens that are frequent within tasks last, then goes by hash; any order gives the same links.

In an opened chunk, members are linked to pivots first; the others, and visitors, find partners by an index over the
members' rarest tokens in the chunk (of a set of n tokens, a partner has one of the first n - ceil(0.85 n) + 1), and
candidates of one component are compared until one links. So a set emits one link for each component that it reaches,
never one for each partner. A group of several chunks has its first member in each of them; members that don't reach its
component visit the other chunks, found by the matrix, which for such groups holds the whole prefixes. So no pair of
different texts is missed and no group's pairs are ever listed.

Rows: null, empty or blank text = the empty set, linked with nothing. Rows that share a doc_id are one vertex. Rows
with a null doc_id get the component of equal sets, if any, else null. Extra columns are ignored. Texts are read whole,
however long: a set's tokens are one value of 8 bytes each.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, rolling

SHINGLE, PER_CENT = 4, 85
LOCAL_TIMES = 3  # occurrences within a task that make a token a candidate for "frequent"
FREQUENT = 12  # sets, as counted within tasks, that make a token frequent
MOST_FREQUENT = 1 << 20  # frequent tokens sent to the workers (8 MB), the most frequent ones
CHUNK_TOKENS = 1 << 21  # tokens of a chunk's members, about
CHUNK_MEMBERS = 1 << 12  # members of a chunk, about
SPREAD, SPREAD_CHUNKS = 256, 64  # a group has a chunk for each SPREAD members, up to SPREAD_CHUNKS of them before the bounds above ask for more
BUCKETS = 256  # of the matrix's counts
SMALL = BUCKETS // 4  # sets of fewer tokens take less room than their counts: their members are opened unasked
TASK_ROWS = 1 << 16  # rows of places in a task, about
BROADCAST_BYTES = 16 << 20  # of a written table that may be broadcast, at 8 bytes a value


def need(n: int, per_cent: int = PER_CENT) -> int:
    """Tokens that a partner of a set of n tokens shares at least."""
    return -(-per_cent * n // 100)


def token_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = b" ".join(words)
    sums = rolling.prefix_sums(raw)
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
    begins = np.append(0, ends[:-1] + 1)
    if len(words) < shingle:
        return rolling.substrings(sums, np.array([0]), np.array([len(raw)]))
    return np.unique(rolling.substrings(sums, begins[: len(ends) - shingle + 1], ends[shingle - 1 :]))


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bucket_counts(tokens: np.ndarray) -> np.ndarray:
    """Tokens in each bucket, at most 65,535."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 0xFFFF).astype(np.uint16)


# ---- the bound ----


class Bounds:
    """A chunk's rows of the token-group matrix: its union's counts and its members'."""

    def __init__(self, ids: list[int], sizes: list[int], counts: list[bytes], per_cent: int):
        self.ids, self.per_cent = np.array(ids), per_cent
        self.sizes = np.array(sizes)
        self.counts = np.frombuffer(b"".join(counts), np.uint16).reshape(-1, BUCKETS)
        self.full = (self.counts == 0xFFFF).any(1)
        self.union = self.counts.max(0)
        self.open = np.zeros(len(ids), bool)

    def may(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Members that may link with a set of these bucket counts."""
        if (counts == 0xFFFF).any():
            return np.ones(len(self.sizes), bool)
        shared = np.minimum(self.counts, counts).sum(1, dtype=np.int64)
        return ((100 + self.per_cent) * shared >= self.per_cent * (self.sizes + size)) | self.full

    def members(self) -> None:
        """Open the members that may link with another one: of sizes near enough, in descending order."""
        order = np.argsort(-self.sizes, kind="stable")
        counts, sizes, full = self.counts[order], self.sizes[order], self.full[order]
        opened = (sizes < SMALL) | full
        least = np.searchsorted(-sizes, -(self.per_cent * sizes / 100), side="right")  # the first that is too small
        for i in range(len(order)):
            j = slice(i + 1, len(order) if full.any() else least[i])
            if j.start >= j.stop or (opened[i] and opened[j].all()):
                continue
            shared = np.minimum(counts[j], counts[i]).sum(1, dtype=np.int64)
            near = ((100 + self.per_cent) * shared >= self.per_cent * (sizes[j] + sizes[i])) | full[j] | full[i]
            opened[j] |= near
            opened[i] |= bool(near.any())
        self.open[order] |= opened

    def visit(self, raw: bytes, size: int) -> bool:
        """Does the bound admit this set? Opens the members that it may link with."""
        counts = np.frombuffer(raw, np.uint16)
        if np.minimum(self.union, counts).sum(dtype=np.int64) < need(size, self.per_cent) and not self.full.any():
            return False
        near = self.may(counts, size)
        self.open |= near
        return bool(near.any())


def admitted(rows: DataFrame, n: int, per_cent: int) -> DataFrame:
    """The (id, place, visit) that the bounds admit, from n rows (place, visit, id, n, counts)."""

    def run(batches):
        import pyarrow as pa

        place, ids, sizes, counts, chunk = None, [], [], [], None
        out: list[tuple[int, int, int]] = []

        def close():
            nonlocal chunk
            if chunk is None and ids:
                chunk = Bounds(ids, sizes, counts, per_cent)
                chunk.members()

        def leave():
            close()
            if chunk is not None:
                out.extend((i, place, 0) for i in chunk.ids[chunk.open].tolist())

        def batch_of(found):
            cols = list(zip(*found)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["id", "place", "visit"])

        for batch in batches:
            for p, visit, doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if p != place:
                    leave()
                    place, ids, sizes, counts, chunk = p, [], [], [], None
                if visit:
                    close()
                    if chunk is not None and chunk.visit(raw, n):
                        out.append((doc, p, 1))
                else:
                    ids.append(doc)
                    sizes.append(n)
                    counts.append(raw)
            if len(out) > 1 << 16:
                yield batch_of(out)
                out = []
        leave()
        yield batch_of(out)

    return dealt(rows, n).mapInArrow(run, "id long, place long, visit int")


# ---- in a chunk ----


class Chunk:
    """Members of one group chunk: an index from their rarest tokens, and the components that are known so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], per_cent: int):
        self.ids, self.sets, self.per_cent = ids, sets, per_cent
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        self.flat = np.concatenate(sets)
        self.union, place, self.count = np.unique(self.flat, return_inverse=True, return_counts=True)
        # A token's rank: rarer ones first, then by value. A member's first tokens by rank are indexed.
        rank = np.empty(len(self.union), np.int64)
        rank[np.lexsort((self.union, self.count))] = np.arange(len(self.union))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((rank[place], owner))
        nth = np.arange(len(order)) - np.repeat(self.ends - self.sizes, self.sizes)
        kept = order[nth < np.repeat(self.prefix(self.sizes), self.sizes)]
        kept = kept[np.argsort(place[kept], kind="stable")]
        self.owner, tokens = owner[kept], place[kept]
        self.begin = np.searchsorted(tokens, np.arange(len(self.union) + 1))
        self.rank = rank
        self.root = list(range(len(ids)))

    def prefix(self, n):
        """Of a set's n tokens, how many hold one that a partner has."""
        return n - -(-self.per_cent * n // 100) + 1

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def linked(self, tokens: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Which of the members link with the set."""
        n = self.sizes[members]
        stop = np.cumsum(n)
        theirs = self.flat[np.arange(stop[-1]) + np.repeat(self.ends[members] - stop, n)]
        at = np.searchsorted(tokens, theirs)
        at[at == len(tokens)] = 0
        shared = np.add.reduceat((tokens[at] == theirs).astype(np.int64), stop - n)
        return 100 * shared >= self.per_cent * (n + len(tokens) - shared)

    def candidates(self, tokens: np.ndarray) -> np.ndarray:
        """Members that have one of the set's rarest tokens among theirs, and are of a size near enough. Tokens that the
        chunk lacks are the rarest."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        room = self.prefix(len(tokens)) - (len(tokens) - len(at))
        if room <= 0:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.rank[at], kind="stable")[:room]]
        begin, size = self.begin[at], self.begin[at + 1] - self.begin[at]
        stop = np.cumsum(size)
        own = np.unique(self.owner[np.arange(stop[-1]) + np.repeat(begin - (stop - size), size)])
        n = self.sizes[own]
        return own[(100 * np.minimum(n, len(tokens)) >= self.per_cent * np.maximum(n, len(tokens)))]

    def reached(self, tokens: np.ndarray, own: int = -1) -> list[int]:
        """One member of each component that the set links with; `own` is the set's place, if it is a member."""
        found = []
        rest = self.candidates(tokens)
        lot = 16
        while len(rest):
            tops = np.array([self.top(i) for i in rest.tolist()])
            rest = rest[~np.isin(tops, [self.top(i) for i in (found if own < 0 else [*found, own])])]
            if len(rest):
                part, rest = rest[:lot], rest[lot:]
                lot *= 2
                for i in part[self.linked(tokens, part)].tolist():
                    if own >= 0 and self.top(i) != self.top(own) or own < 0 and self.top(i) not in {self.top(k) for k in found}:
                        found.append(i)
                        if own >= 0:
                            self.root[self.top(i)] = self.top(own)
        return found

    def inner(self) -> list[tuple[int, int]]:
        """Links that give the components of the members' link graph."""
        out, n = [], len(self.ids)
        rest = np.arange(1, n)
        pivot = 0
        for _ in range(8):  # pivots; what they don't reach is looked up below
            if not len(rest):
                break
            hit = np.concatenate([self.linked(self.sets[pivot], rest[k : k + 256]) for k in range(0, len(rest), 256)])
            for i in rest[hit].tolist():
                if self.top(i) != self.top(pivot):
                    self.root[self.top(i)] = self.top(pivot)
                    out.append((self.ids[pivot], self.ids[i]))
            rest = rest[~hit]
            if len(rest):
                pivot, rest = int(rest[0]), rest[1:]
        tops = np.array([self.top(i) for i in range(n)])
        largest = np.bincount(tops).argmax()
        for i in np.flatnonzero(tops != largest).tolist():
            out += [(self.ids[i], self.ids[j]) for j in self.reached(self.sets[i], i)]
        return out


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows of places, about TASK_ROWS of n a task at most, each place's in order, members first."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    return rows.repartition(parts, "place").sortWithinPartitions("place", "visit", "id")


def open_chunks(rows: DataFrame, n: int, per_cent: int) -> DataFrame:
    """Edges (src, dst) from n rows (place, visit, id, tokens): members (visit 0) and visitors (visit 1) of each chunk.

    A chunk's rows arrive in order, members first, so a task holds one chunk's members and one visitor at a time.
    """

    def run(batches):
        import pyarrow as pa

        place, ids, sets, chunk = None, [], [], None
        edges: list[tuple[int, int]] = []

        def close():
            nonlocal chunk
            if chunk is None and ids:
                chunk = Chunk(ids, sets, per_cent)
                edges.extend(chunk.inner())

        def batch_of(found):
            src, dst = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            for p, visit, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != place:
                    close()
                    place, ids, sets, chunk = p, [], [], None
                tokens = np.frombuffer(raw, np.uint64)
                if visit:
                    close()
                    if chunk is not None:
                        edges.extend((doc, chunk.ids[j]) for j in chunk.reached(tokens))
                else:
                    ids.append(doc)
                    sets.append(tokens)
            if len(edges) > 1 << 16:
                yield batch_of(edges)
                edges = []
        close()
        yield batch_of(edges)

    return dealt(rows, n).mapInArrow(run, "src long, dst long")


# ---- the join ----


def frequent_tokens(docs: DataFrame, shingle: int) -> np.ndarray:
    """Tokens of many different sets, most frequent first where there are too many; counted within tasks.

    They only shape the order of tokens: links don't depend on them.
    """

    def run(batches):
        import pyarrow as pa

        seen, held, size = set(), [], 0

        def tally():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL_TIMES
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = token_set(text, shingle)
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                if size > 1 << 22:
                    yield tally()
                    seen, held, size = set(), [], 0
        if held:
            yield tally()

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def prefixes(docs: DataFrame, frequent, shingle: int, per_cent: int) -> DataFrame:
    """Rows (doc_id, n, key, prefix, counts) of every document; prefix tokens in the order's first places."""

    def run(batches):
        import pyarrow as pa

        late, extra = frequent.value, least_shared(per_cent)
        for batch in batches:
            n, keys, firsts, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = token_set(text, shingle)
                size = len(tokens)
                n.append(size)
                keys.append(set_key(tokens))
                counts.append(bucket_counts(tokens).tobytes())
                if size and len(late):
                    at = np.searchsorted(late, tokens)
                    at[at == len(late)] = 0
                    hit = late[at] == tokens
                    if hit.any():
                        tokens = np.concatenate([tokens[~hit], tokens[hit]])
                firsts.append(tokens[: size - need(size, per_cent) + extra].view(np.int64) if size else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["doc_id", "n", "key", "prefix", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, prefix array<long>, counts binary")


def least_shared(per_cent: int) -> int:
    """The `l` of the prefix rule: 4, or less where different sets can link by fewer tokens. (Sets of n and n + 1 tokens
    link from n = per_cent / (100 - per_cent) on, so linked sets that differ share that many.)"""
    return 4 if per_cent >= 100 else max(1, min(4, per_cent // (100 - per_cent)))


def small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, for a join: broadcast if it has BROADCAST_BYTES at most, else left to Spark,
    which shuffles both sides and splits hot keys."""
    most = BROADCAST_BYTES // (8 * len(written.columns))
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def sets_of(docs: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """Rows (place, visit, id, tokens) for places (id, place, visit)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [token_set(t, shingle).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["place", "visit", "id", "tokens"])

    joined = docs.select(F.col("doc_id").alias("id"), "text").join(small(places), "id")
    return joined.select("place", "visit", "id", "text").mapInArrow(run, "place long, visit int, id long, tokens binary")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per document, in a spooled table; working tables are deleted."""
    with common.scope(documents.sparkSession):
        return common.keep(common.spool(found_components(documents, id_col, text_col, shingle, per_cent), "join-components"))


def found_components(documents: DataFrame, id_col: str, text_col: str, shingle: int, per_cent: int) -> DataFrame:
    spark = documents.sparkSession
    common.small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, shingle))  # MOST_FREQUENT numbers at most
    each = common.spool(prefixes(docs, frequent, shingle, per_cent), "join-prefixes")
    # Equal sets collapse: the smallest id stands for them. Only the others' ids are joined back to drop their rows.
    named = each.where("n > 0 and doc_id is not null")
    same = common.spool(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("k")).where("k > 1").select("key", "id"), "join-same")
    spare = common.spool(named.select("doc_id", "key").join(small(same), "key").where("doc_id <> id").select("doc_id", "key").distinct(), "join-spare")
    sets = named.join(small(spare), ["doc_id", "key"], "left_anti").select(F.col("doc_id").alias("id"), "key", "n", "prefix", "counts")
    repeats = each.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null").limit(1).count()
    if repeats:
        sets = sets.dropDuplicates(["id", "key"])
    sets = common.spool(sets, "join-sets")

    each = each.drop("prefix", "counts")

    first = F.col("n") - F.ceil(F.lit(2 * per_cent) * F.col("n") / (100 + per_cent)) + least_shared(per_cent)
    tokens = sets.select("id", first.alias("first"), F.posexplode("prefix").alias("at", "token")).select("token", "id", (F.col("at") < F.col("first")).alias("index"))
    common_tokens = common.spool(tokens.groupBy("token").agg(F.count("*").alias("df"), F.count_if("index").alias("di")).where("df > 1 and di > 0").select("token", "df"), "join-tokens")
    common.free_shuffles(spark)
    shared = common.spool(tokens.join(small(common_tokens), "token"), "join-shared")  # (token, id, index, df): tokens that may find a partner
    common.free_shuffles(spark)
    # Groups: a set's home is its shared token in the matrix that most sets have; its chunk goes by a hash of the id.
    home = shared.where("index").groupBy("id").agg(F.max(F.struct("df", "token")).getField("token").alias("home"))
    home = common.spool(home.join(sets.select("id", "n"), "id"), "join-home")
    spread = F.least(F.lit(SPREAD_CHUNKS), F.ceil(F.count("*") / SPREAD))
    chunks = F.greatest(F.ceil(F.sum("n") / CHUNK_TOKENS), F.ceil(F.count("*") / CHUNK_MEMBERS), spread).cast("int")
    groups = common.spool(home.groupBy("home").agg(chunks.alias("chunks"), F.min("id").alias("pivot"), F.count("*").alias("size")), "join-groups")
    split = groups.where("chunks > 1")
    is_split = bool(split.limit(1).count())
    if is_split:
        members = home.join(small(common.spool(split, "join-split")), "home", "left").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("id"), F.col("chunks"))).otherwise(0).cast("int"))
        members = common.spool(members.select("id", "n", "home", "chunk", F.coalesce("chunks", F.lit(1)).alias("chunks")), "join-members")
    else:
        members = home.select("id", "n", "home", F.lit(0).alias("chunk"), F.lit(1).alias("chunks"))
    # The matrix: tokens by chunks, with the sizes of the members that bring the token.
    near = small(members)
    entries = shared.join(near, "id").where(F.col("index") | (F.col("chunks") > 1))
    matrix = entries.groupBy("token", "home", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("chunks").alias("of"))
    room = F.when(F.col("of") > 1, 100 * F.col("n") >= per_cent * F.col("least")).otherwise(F.col("least") <= F.col("n"))
    going = shared.select("token", "id").join(sets.select("id", "n"), "id").join(matrix, "token").where((100 * F.col("most") >= per_cent * F.col("n")) & room)
    going = going.groupBy("id", "home", "chunk").agg(F.count("*").alias("common")).where(F.col("common") >= least_shared(per_cent)).select("id", "home", "chunk")
    visits = common.spool(going.join(near.select("id", "home", "chunk"), ["id", "home", "chunk"], "left_anti"), "join-visits")
    place: Column = F.xxhash64("home", "chunk")
    # Members of split groups visit the other chunks of their own group later, if they have to.
    if is_split:
        own = near.select("id", "home", F.col("chunks").alias("of"))
        later = common.spool(visits.join(own, ["id", "home"]).select("id", "home", "chunk"), "join-later")
        visits = common.spool(visits.join(small(later), ["id", "home", "chunk"], "left_anti"), "join-others")
    pivots = split.select(F.col("pivot").alias("id"), "home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    # A group of one member without visitors has nothing to open.
    alive = groups.where("size > 1").select("home").union(visits.select("home")).distinct()
    inside = members.select("id", "home", "chunk").union(pivots).distinct().join(alive, "home")
    places = common.spool(inside.select("id", place.alias("place"), F.lit(0).alias("visit")).union(visits.select("id", place.alias("place"), F.lit(1).alias("visit"))), "join-places")
    bounds = sets.select("id", "n", "counts")

    def edges_at(where: DataFrame) -> DataFrame:
        """Links found at the places that the bounds admit."""
        kept = common.spool(admitted(bounds.join(small(where), "id").select("place", "visit", "id", "n", "counts"), where.count(), per_cent), "join-admitted")
        return common.spool(open_chunks(sets_of(docs, kept, shingle), kept.count(), per_cent), "join-edges")

    edges = edges_at(places)
    if is_split:
        # Members of a split group that its pivot's component doesn't hold visit the chunks that the matrix names.
        reach = common.connected(spark, edges, "join-first")
        lead = split.select("home", F.col("pivot").alias("id")).join(reach, "id", "left").select("home", F.coalesce("component", "id").alias("lead"))
        apart = later.join(reach, "id", "left").join(lead, "home").where(F.coalesce("component", "id") != F.col("lead"))
        again = members.where("chunks > 1").select("id", place.alias("place"), F.lit(0).alias("visit")).union(apart.select("id", place.alias("place"), F.lit(1).alias("visit")))
        edges = edges.union(edges_at(common.spool(again, "join-again")))

    reach = common.connected(spark, edges, "join")
    classes = sets.select("key", "id").join(reach, "id", "left").select("key", F.coalesce("component", "id").alias("class"))
    # Rows that share a doc_id are one vertex: a doc_id's classes are its different sets' classes, all linked.
    ids = each.groupBy("doc_id").agg(F.countDistinct("key").alias("k")).where("k > 1 and doc_id is not null").select("doc_id")
    if repeats and ids.limit(1).count():
        ties = each.where("n > 0").join(ids, "doc_id").select("doc_id", "key").join(classes, "key")
        merged = common.connected(spark, ties.select(F.col("doc_id").alias("src"), F.col("class").alias("dst")), "join-ids")
        classes = classes.join(merged.withColumnRenamed("id", "class").withColumnRenamed("component", "least"), "class", "left").select("key", F.coalesce("least", "class").alias("class"))
        least = ties.select("doc_id").distinct().join(merged.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("tied"))
        out = each.select("doc_id", "n", "key").join(classes, "key", "left").join(least, "doc_id", "left").withColumn("class", F.coalesce("tied", "class"))
    else:
        out = each.select("doc_id", "n", "key").join(classes, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))
