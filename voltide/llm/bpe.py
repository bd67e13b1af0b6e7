"""Byte-pair encoding through a table of distinct words, and decoding through the piece table.

1. Documents are taken in blocks of a few megabytes. A block's text becomes a list of distinct words and,
   per document, the positions of its words in that list.
2. Words are dealt out by hash, so each distinct word of the whole corpus meets in one place and is merged
   into ids there once, however many blocks hold it.
3. The ids return to their block by position in its word list and are laid out along the documents.
4. Decoding looks each id up in the id-to-piece table, whose size is bounded by the vocabulary; it is
   broadcast together with the merge table.

Words travel as compressed sorted lists and positions as compressed integers, which keeps the exchanges
below the size of the text. The number of hash buckets follows the input, so the words of one bucket fit
a task.

The text is normalised as the vocabulary file states: composed (NFC), white space folded, lower-cased
character by character, cut by its word pattern; special strings in a text become their ids.

Defined results: a null or empty text has no ids and decodes to ''; rows are treated one by one, so ties and
repeated rows each get their result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import schema, text_slices

WORD_END = "</w>"
# The vocabulary's word pattern, its white space, and separators that only Python takes as such.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACES = re.compile("[\x1c-\x1f]")


@dataclass
class Vocabulary:
    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    specials: dict[str, int]
    pieces: list[str]


def default_vocabulary() -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_vocabulary(path: str) -> Vocabulary:
    """Vocabulary, merge ranks and special strings of a tokenizer file in JSON."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [""] * (1 + max([*ids.values(), *specials.values()]))
    for piece, i in [*ids.items(), *specials.items()]:
        pieces[i] = piece
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return Vocabulary(ids, {(a, b): r for r, (a, b) in enumerate(pairs)}, specials, pieces)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Encoder:
    """Ids of single words; pieces that recur between words are kept for the life of a task, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 200_000) -> None:
        self.v, self.letters, self.keep, self.kept = vocabulary, byte_letters(), keep, {}

    def merge(self, piece: str) -> list[int]:
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        ranks = self.v.ranks
        while len(parts) > 1:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]), math.inf)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.v.ids[p] for p in parts if p in self.v.ids]

    def word(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.v.specials[word[1:]]]
        out: list[int] = []
        for piece in PIECES.findall(word):
            ids = self.kept.get(piece)
            if ids is None:
                ids = self.merge(piece) if len(piece) < 2000 else self.merge_long(piece)
                if len(self.kept) < self.keep:
                    self.kept[piece] = ids
            out += ids
        return out

    def merge_long(self, piece: str) -> list[int]:
        """The same merges for a very long piece, with a heap, so that time stays near linear."""
        import heapq

        parts: list[str | None] = [self.letters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.v.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    pair = (parts[left], parts[after[left]])
                    if pair in self.v.ranks:
                        heapq.heappush(heap, (self.v.ranks[pair], left, *pair))
        return [self.v.ids[p] for p in parts if p is not None and p in self.v.ids]


def split_words(text: str, specials: re.Pattern) -> list[str]:
    """Normalised words; a special string is one word with a space in front, which no other word has."""
    if "<|" in text:
        parts = specials.split(text)
        if len(parts) > 1:
            return [w for i, p in enumerate(parts) for w in ([f" {p}"] if i % 2 else split_words(p, specials))]
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    if ODD_SPACES.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def special_pattern(vocabulary: Vocabulary) -> re.Pattern:
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True)) + ")")


@dataclass
class Block:
    name: bytes                 # digest of what the block holds
    rows: pa.RecordBatch
    words: list[str]            # distinct, by bucket, then in order
    starts: list[int]           # where each bucket's words begin
    positions: list[np.ndarray]  # of each document's words


def blocks(batches: Iterator[pa.RecordBatch], specials: re.Pattern, buckets: int, block_bytes: int) -> Iterator[Block]:
    for rows, data, ends in text_slices(batches, limit=block_bytes):
        texts = [t or "" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
        split = [split_words(t, specials) for t in texts]
        groups: list[list[str]] = [[] for _ in range(buckets)]
        for w in set().union(*split):
            groups[zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets].append(w)
        starts, words = [0], []
        for g in groups:
            words += sorted(g)
            starts.append(len(words))
        at = {w: i for i, w in enumerate(words)}
        name = hashlib.blake2b(data.tobytes() + ends.tobytes() + repr(rows.column(0).to_pylist()).encode(), digest_size=16).digest()
        yield Block(name, rows, words, starts, [np.fromiter(map(at.__getitem__, s), np.uint32, len(s)) for s in split])


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text: str = "text",
           buckets: int | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, ids, decoded) per row: ``ids`` little-endian unsigned 32-bit integers, ``decoded`` the text of the ids.

    ``docs`` must read a table, so that both passes over it see the same blocks; a pass that doesn't fails.
    ``buckets`` (default: the shuffle partitions) are the hash parts of the word table.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(vocabulary)   # bounded by the vocabulary file
    specials = special_pattern(vocabulary)
    source = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in blocks(batches, specials, n, block_bytes):
            lists = [pack("\n".join(b.words[i:j]).encode("utf-8", "surrogatepass")) for i, j in zip(b.starts, b.starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([b.name] * n), pa.array(range(n), pa.int32()), pa.array(lists)], ["block", "bucket", "data"])

    def encode_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        encoder, table, now = Encoder(shared.value), {}, None
        for b in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    table, now = {}, bucket
                found = []
                for w in unpack(data).decode("utf-8", "surrogatepass").split("\n"):
                    if w:
                        ids = table.get(w)
                        if ids is None:
                            table[w] = ids = np.array(encoder.word(w), np.uint32)
                        found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([
                    pack(np.concatenate([np.array([len(found)], np.uint32), lengths, flat]).tobytes())])], ["block", "bucket", "data"])

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in blocks(batches, specials, n, block_bytes):
            # frequent words first, so that most positions are small numbers
            flat = np.concatenate(b.positions)
            order = np.argsort(-np.bincount(flat, minlength=len(b.words)), kind="stable").astype(np.uint32)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            coded = rank[flat]
            planes = np.ascontiguousarray(coded.view(np.uint8).reshape(-1, 4).T).tobytes()
            head = np.array([len(b.positions), len(flat), len(order)], np.uint32)
            lengths = np.fromiter(map(len, b.positions), np.uint32, len(b.positions))
            yield pa.RecordBatch.from_arrays([
                pa.array([b.name]), pa.array([-1], pa.int32()), pa.array([pack(head.tobytes() + lengths.tobytes() + order.tobytes() + planes)]),
                pa.array([b.rows.column(0).to_pylist()], pa.list_(b.rows.column(0).type))], ["block", "bucket", "data", "row_ids"])

    packed = T.StructType.fromDDL("block binary, bucket int, data binary")
    with_ids = T.StructType([*packed.fields, T.StructField("row_ids", T.ArrayType(id_type))])
    lists = source.mapInArrow(word_lists, packed)
    encoded = lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_lists, packed)
    laid = source.mapInArrow(layouts, with_ids)
    meeting = laid.unionByName(encoded.withColumn("row_ids", F.lit(None).cast(with_ids["row_ids"].dataType)))
    target = T.StructType([T.StructField("id", id_type), *schema("ids binary, decoded string").fields])

    def assemble(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "data", "row_ids"))), key=lambda r: r[0])
        # equal blocks have one name and equal rows: k of them come as k equal sets, of which one is worked out
        k = sum(r[0] == -1 for r in rows)
        if not k or [r[0] for r in rows] != [b for b in range(-1, n) for _ in range(k)]:
            raise ValueError("the two passes over the documents saw different blocks; pass a table that reads the same twice")
        rows = rows[::k]
        counts, flats = [], []
        for _, data, _ in rows[1:]:
            x = np.frombuffer(unpack(data), np.uint32)
            counts.append(x[1:1 + x[0]])
            flats.append(x[1 + x[0]:])
        lengths, flat = np.concatenate(counts).astype(np.int64), np.concatenate(flats)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = unpack(rows[0][1])
        docs_n, words_n, distinct = np.frombuffer(raw, np.uint32, 3)
        per_doc = np.frombuffer(raw, np.uint32, docs_n, 12)
        order = np.frombuffer(raw, np.uint32, distinct, 12 + 4 * docs_n)
        planes = np.frombuffer(raw, np.uint8, 4 * words_n, 12 + 4 * int(docs_n) + 4 * int(distinct)).reshape(4, -1)
        word = order[np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)] if words_n else np.zeros(0, np.uint32)
        pieces, ids, decoded, at = shared.value.pieces, [], [], 0
        for size in per_doc.tolist():
            mine = word[at:at + size]
            at += size
            got = gather(flat, starts[mine], lengths[mine])
            ids.append(got.astype("<u4").tobytes())
            decoded.append(join_pieces(got, pieces))
        one = pa.Table.from_arrays([pa.array(rows[0][2], table.schema.field("row_ids").type.value_type), pa.array(ids, pa.binary()),
                                    pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
        return pa.concat_tables([one] * k)

    out = meeting.groupBy("block").applyInArrow(assemble, target)
    return out.withColumnRenamed("id", id_column)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of each, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.uint32)
    first = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return flat[first + np.arange(total)]


def join_pieces(ids: np.ndarray, pieces: list[str]) -> str:
    """The text of ids: their pieces with spaces between, as a file without a decoder section asks."""
    return " ".join(map(pieces.__getitem__, ids.tolist()))


def decode(frame: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``, the text of the packed ids. A null is decoded as ''."""
    shared = frame.sparkSession.sparkContext.broadcast(vocabulary.pieces)
    at = frame.columns.index(ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [join_pieces(np.frombuffer(x or b"", "<u4"), shared.value) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return frame.mapInArrow(rows, T.StructType([*frame.schema.fields, T.StructField("decoded", T.StringType())]))
