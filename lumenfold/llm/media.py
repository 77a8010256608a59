"""Media columns: documents as interleaved sequences of text and media references.

A document is HTML: paragraphs and <figure><img src="cas:DIGEST" alt=...><figcaption>...</figcaption></figure>. Parsing
yields an ordered array of structs (position, kind, text, digest, caption). Payloads lie in a content-addressed store
(one row per stored object: digest, form, bytes); references resolve by a join on the digest, so payload bytes are
never shuffled: the store's features and sizes are computed where the bytes are read, and only they are joined.

The stored form is a binary greyscale PGM image, 24 samples wide; a payload is padded with bytes 255 to a positive
multiple of 576 (24 x 24), so every payload byte is one 8-bit sample. Byte 255 isn't in UTF-8, so the text's length is
known from the samples. `article` sets a text's own lines as paragraphs with two figures among them: the whole text's
image after the first half of the lines, and its last 576 samples at the end.

Rows: null or empty text = one block of padding and no paragraph; equal texts share a stored object; repeated rows each
give a row; references to objects that the store lacks keep nulls. Texts are taken whole, however long. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

BLOCK, WIDTH, PAD = 576, 24, 255
TAIL = 32
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


# ---- the stored form ----


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, unpadded length)."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def to_pgm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def from_pgm(stored: bytes) -> bytes:
    """The samples of a PGM written by to_pgm; raises on a damaged one."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a stored image")
    return samples


def feature(samples: bytes) -> str:
    """A perceptual feature: 64 bits, whether each cell of an 8 x 8 grid of the image is lighter than the median cell."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    rows = np.add.reduceat(image.astype(np.float64), np.arange(8) * len(image) // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * WIDTH // 8, axis=1) / np.diff(np.append(np.arange(8) * len(image) // 8, len(image)))[:, None]
    return f"{int.from_bytes(np.packbits(cells > np.median(cells)).tobytes(), 'big'):016x}"


# ---- interleaved sequences ----


def figure(digest: str, caption: str) -> str:
    return f'<figure><img src="cas:{digest}" alt="{escape(caption)}"><figcaption>{escape(caption)}</figcaption></figure>'


WHOLE, END = "whole text", "end of the text"


def article(text: str | None) -> tuple[str, list[tuple[str, bytes]]]:
    """(html of a text's lines and its two figures, (digest, stored form) of these)."""
    samples, _ = payload(text)
    media = [(hashlib.sha256(x).hexdigest(), x) for x in (to_pgm(samples), to_pgm(samples[-BLOCK:]))]
    lines = [f"<p>{escape(x)}</p>" for x in (text or "").split("\n") if x and not x.isspace()]
    half = (len(lines) + 1) // 2
    return "".join([*lines[:half], figure(media[0][0], WHOLE), *lines[half:], figure(media[1][0], END)]), media


class _Reader(HTMLParser):
    BREAKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "figure", "section", "article", "blockquote", "td", "tr"}  # fixed values
    SILENT = {"script", "style", "template", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.caption, self.silent = [], [], None, 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append(["text", text, None, None])
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            have = dict(attrs)
            src = have.get("src") or ""
            self.items.append(["media", src if not src.startswith("cas:") else None, src[4:] if src.startswith("cas:") else None, have.get("alt")])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            media = next((x for x in reversed(self.items) if x[0] == "media"), None)
            if media is not None and said:
                media[3] = said
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered text and media structs; a media without a cas: digest keeps its source as text."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return [{"position": k, "kind": kind, "text": text, "digest": digest, "caption": caption} for k, (kind, text, digest, caption) in enumerate(reader.items)]


SEQUENCE_KIND = [("position", "int32"), ("kind", "string"), ("text", "string"), ("digest", "string"), ("caption", "string")]


def parsed(docs: DataFrame, col: str, keep: list[str], read) -> DataFrame:
    """docs' columns `keep` with `items`, what `read` finds in the column's values."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(n, getattr(pa, t)()) for n, t in SEQUENCE_KIND]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([read(h) for h in batch.column(len(keep)).to_pylist()], kind)], names=[*keep, "items"])

    own = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return docs.select(*keep, F.col(f"`{col}`").alias("_value")).mapInArrow(run, f"{fields}, items {SEQUENCE}")


def sequences(docs: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with `items`, the parsed sequence of html_col."""
    return parsed(docs, html_col, keep, sequence)


def articles(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with `items`, the parsed sequence of the text's article."""
    return parsed(docs, text_col, keep, lambda text: sequence(article(text)[0]))


def store(docs: DataFrame, text_col: str) -> DataFrame:
    """Store the media of each text's article; rows (digest, stored), spooled.

    Stored objects are written with the documents' partitioning. A task skips objects that it has stored before;
    equal objects of different tasks have the same digest and bytes, and readers take any.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        for batch in batches:
            digests, forms = [], []
            for text in batch.column(0).to_pylist():
                for digest, stored in article(text)[1]:
                    key = bytes.fromhex(digest)[:16]
                    if key not in seen:
                        digests.append(digest)
                        forms.append(stored)
                    if len(seen) < 1 << 18:  # a repeated object beyond this is stored again, to the same effect
                        seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(forms, pa.binary())], names=["digest", "stored"])

    return common.spool(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "digest string, stored binary"), "media")


FACTS = [("digest", "string"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]


def stored_facts(media: DataFrame) -> DataFrame:
    """One row per digest of the store, from the stored bytes: sizes, digests and the feature."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in FACTS])
        for batch in batches:
            out = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                samples = from_pgm(stored)
                form = hashlib.sha256(stored).hexdigest()
                if form != digest:
                    raise ValueError(f"damaged object {digest}")
                out.append((digest, len(samples.rstrip(bytes([PAD]))), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), form, feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    return media.select("digest", "stored").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in FACTS)).dropDuplicates(["digest"])


def references(found: DataFrame) -> DataFrame:
    """A row for each media item of parsed sequences (id, items)."""
    return found.select("id", F.explode("items").alias("item")).where("item.kind = 'media'").select("id", "item.position", "item.caption", "item.digest")


def resolve(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """References (with a column digest) with what the store knows of them; unknown digests keep nulls."""
    return refs.join(facts, "digest", "left")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole-text image, as the figure in its parsed article refers to it; also where both figures stand
    among the article's items, and the digest of the second one's object."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The facts are written before they are joined: a digest that many documents share can then be split among tasks.
    facts = common.spool(stored_facts(store(docs, "text")), "media-facts")
    figures = F.filter("items", lambda x: x["kind"] == "media")
    at = lambda caption: F.element_at(F.filter(figures, lambda x: x["caption"] == caption), 1)
    refs = articles(docs, "text", ["doc_id"]).select("doc_id", at(WHOLE).alias("whole"), at(END).alias("end"), F.size("items").cast("long").alias("n_items"))
    refs = refs.select("doc_id", "n_items", F.col("whole.digest").alias("digest"), "whole.position", F.col("end.digest").alias("end_digest"), F.col("end.position").alias("end_position"))
    out = resolve(refs, facts).withColumnRenamed("digest", "own").withColumnRenamed("end_digest", "digest")
    out = resolve(out, facts.select("digest", F.col("media_sha256").alias("end_sha256")))
    return out.select("doc_id", *[n for n, _ in FACTS if n != "digest"], "n_items", "position", "end_position", "end_sha256")
