"""The pipeline's stages keep clean documents and act on the rest."""

import hashlib
import random
import re

import pytest

from lumenfold.llm import byte_bpe, common, pii, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, tmp_path):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("aeioubcdlmnrst") for _ in range(pick.randint(3, 8)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n=60: " ".join(pick.choice(vocabulary) for _ in range(n))
    docs, labels = {}, []
    for i in range(400):
        t, toxic = text().split(), i % 4 == 0
        if toxic:
            t[pick.randrange(60)] = pick.choice(["moron", "scumbag"])
        docs[i], _ = " ".join(t), labels.append((i, int(toxic)))
    docs[1000] = text(80)
    docs[1001] = docs[1000] + " " + word()
    docs[1002] = docs[1000]
    passage = text(30)
    docs[1003] = passage + " " + text(5)
    docs[1004] = text(900) + " " + passage + " " + text(900)
    docs[1005] = "mail ab.12@mail1.example.com " + text()
    docs[1006], docs[1007] = None, ""
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), i) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, passage


def test_stages(spark, folder):
    path, docs, passage = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, path)
        frame.write.parquet(f"{path}/out-{name}")
        frame = spark.read.parquet(f"{path}/out-{name}")
        seen[name] = {r["doc_id"]: r for r in frame.collect()}
        if name != "byte_bpe":
            assert frame.columns == columns
    toxic, near, clean, private, last = seen.values()
    assert not any(i % 4 == 0 for i in toxic if i < 400) and sum(i < 400 for i in toxic) == 300 and {1003, 1004, 1006, 1007} <= set(toxic)
    assert set(toxic) - set(near) == {1001, 1002}
    assert set(near) - set(clean) == {1003} and passage not in clean[1004]["text"] and clean[1004]["n_chars"] == len(clean[1004]["text"])
    assert all(clean[i]["text"] == docs[i] for i in clean if i != 1004)
    assert set(private) == set(clean) and "ab.12@mail1" not in private[1005]["text"] and all(private[i]["text"] == docs[i] for i in private if i not in (1004, 1005))
    assert set(last) == set(private) and last[1006]["n_tokens"] == last[1007]["n_tokens"] == 0 and all(len(r["ids"]) == r["n_tokens"] for r in last.values())
    assert corpus_pipeline.run(spark, path).count() == len(last)


def test_run_equals_brute_force(spark, folder, tmp_path):
    """run() against plain versions of every stage, document by document; the learned toxicity model is taken as given."""
    from test_dedup import truth
    from test_texts import brute, plain_pseudonym

    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = folder[0]
    before = spark.read.parquet(f"{path}/documents.parquet")
    extra = [(None, "a document without an id says something here and goes on for some words more", "en", "s", 1, 1), (1000, "another text of a repeated id that is unlike all of the others in this small folder", "en", "s", 1, 1), (1006, "and one more", "de", "s", 1, 1)]
    extra += [(None, extra[0][1] + " again", "en", "s", 1, 1), extra[1], (None, None, "en", None, None, None)]
    every = tmp_path / "all"
    before.union(spark.createDataFrame(extra, before.schema)).write.parquet(str(every / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(str(every / f"{name}.parquet"))
    docs, labels = (spark.read.parquet(str(every / f"{n}.parquet")) for n in ("documents", "labels"))
    scorer = toxicity.Scorer(*toxicity.learn(docs, labels))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect() if scorer.score(r["text"])[0] < toxicity.THRESHOLD]
    once = {}
    for r in rows:  # equal rows are one; others are documents of their own, whatever their ids
        once.setdefault(r[:2], r)
    rows = list(once.values())
    ids = [r[0] for r in rows]
    vertex = [r[0] if r[0] is not None and ids.count(r[0]) == 1 else 10**9 + k for k, r in enumerate(rows)]
    _, least = truth([(v, r[1]) for v, r in zip(vertex, rows)], 5, 80)
    groups = {}
    for v, r in zip(vertex, rows):
        groups.setdefault(least[v], []).append((v, r))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(str(every / "benchmark.parquet")).collect()]
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(common.tokenizer_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    firm, either = [], []
    for members in groups.values():
        out = []
        for v, (doc, text, lang, source) in members:
            n, hit, _ = brute(text, items)
            if hit and 20 * hit >= n:
                continue
            if hit:
                words = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
                own = items[0][1].split()
                at = next(i for i in range(len(words)) if [m[0].lower() for m in words[i : i + len(own)]] == own)
                text = text[: words[at].start()] + text[words[at + len(own) - 1].end() :]
            text = text and re.sub(pii.ANY, lambda m: plain_pseudonym(m[0], pii.DEMONSTRATION_KEY), text)
            tokens = lib.encode_ordinary(text or "")
            out.append((v, (doc, lang, source, len(tokens), tuple(tokens), hashlib.sha256((text or "").encode()).hexdigest())))
        if members and min(v for v, _ in members) >= 10**9:
            either.append([x for _, x in out])  # rows without ids of their own: one of them
        else:
            firm += [x for v, x in out if v == min(k for k, _ in members)]
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(every)).collect()]
    assert len(got) == len(firm) + len(either)
    for x in firm:
        got.remove(x)
    for choice in either:
        got.remove(next(x for x in choice if x in got))
    assert not got and len(firm) > 280 and len(either) >= 4
