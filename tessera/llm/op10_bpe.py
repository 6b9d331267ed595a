"""BPE encoding and decoding through a table of distinct words.

1. Texts are split at white space into words. Words that are frequent anywhere (a bounded
   number) form one table of distinct words; every other occurrence is a row (text, position, word).
2. Each distinct word is encoded once: the frequent ones in their table, the others where an
   exchange by word has brought all rows of a word together, sorted.
3. Ids are joined back by position: frequent words by a broadcast of their table, whose size
   is bounded, the others by a join on the text.
4. Decoding joins each id to its piece and puts the pieces together.

A row for each occurrence of every word would shuffle several times the text; so only those of
the rarer words are rows, and a text moves as numbers of frequent words. Pre-tokenization and normalization of
this tokenizer do not look across white space, so words may be encoded on their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.workers import trimmed
from tessera.plans.staging import stage

#: Words in the broadcast table at most; their number decides only what is a row of its own.
FREQUENT_WORDS = 1 << 20
#: How many of them are looked up as objects; the others, which are met less, are found by hash in sorted arrays.
HELD_WORDS = 1 << 17
#: White space on which texts are split: a part of what the tokenizer drops.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Rows that are put together at once.
_SOME = 256
_PLACES = "key long, size int, spot int, word string"


@lru_cache(maxsize=1)
def load(definition: str) -> Tokenizer:
    """Tokenizer of a definition without truncation or padding."""
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(text: str) -> list[str]:
    """Maximal runs between white space; separators U+001C-1F are not white space here."""
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


def _squeezed(values: np.ndarray) -> bytes:
    """Values below 2^24 as byte planes, lowest first, which compress well where most values are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _values(raw: bytes) -> np.ndarray:
    """Inverse of :func:`_squeezed`."""
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(3, -1).astype(np.uint32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


class Numbers:
    """Numbers from 1 of distinct words in order. The first :data:`HELD_WORDS` are keys of a dict; as objects, all would take three times the memory."""

    def __init__(self, words: pa.StringArray, held: int | None = None) -> None:
        held = HELD_WORDS if held is None else held
        self.held = {w: i for i, w in enumerate(words.slice(0, held).to_pylist(), 1)}
        self.rest = words.slice(held)
        pieces = (self.rest.slice(i, 1 << 15).to_pylist() for i in range(0, len(self.rest), 1 << 15))
        hashes = np.fromiter((h for piece in pieces for h in map(hash, piece)), np.int64, len(self.rest))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def of(self, words: list[str]) -> np.ndarray:
        """The number of each word, 0 if it has none."""
        out = np.fromiter(map(self.held.get, words, repeat(0)), np.uint32, len(words))
        left = np.flatnonzero(out == 0) if len(self.hashes) else np.zeros(0, np.int64)
        hashes = np.fromiter((hash(words[i]) for i in left.tolist()), np.int64, len(left))
        at = np.searchsorted(self.hashes, hashes)
        while len(left):
            # Equal hashes stand side by side; the words themselves decide.
            like = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes))
            left, hashes, at = left[like], hashes[like], at[like]
            place = self.order[at]
            same = pc.equal(self.rest.take(pa.array(place)), pa.array([words[i] for i in left.tolist()], pa.string())).to_numpy(zero_copy_only=False).astype(bool)
            out[left[same]] = place[same] + len(self.held) + 1
            left, hashes, at = left[~same], hashes[~same], at[~same] + 1
        return out


def frequent_words(texts: DataFrame, most: int = FREQUENT_WORDS) -> DataFrame:
    """``(word, n)``: the ``most`` most frequent of the words that stand twice or more. They are counted before they are shuffled, and sent in order, which compresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[str] = Counter()
            for t in batch.column(0):
                count.update(split_words(t.as_py() or ""))
            words = sorted(count)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([count[w] for w in words], pa.int64())], ["word", "n"])

    counted = texts.select("text").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").orderBy(F.col("n").desc(), "word").limit(most)


def _encode(words: list[str], definition: str, kind: str) -> pa.Array:
    """Ids of each word, encoded on its own, as bytes of numbers of ``kind``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return pa.array([np.array(e.ids, dtype=kind).tobytes() for e in load(definition).encode_batch_fast(words, add_special_tokens=False)], pa.binary())


def encoded_words(words: DataFrame, definition: str, kind: str) -> DataFrame:
    """``(word, n, ids)`` of a table of distinct words ``(word, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _encode(batch.column(0).to_pylist(), definition, kind)], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(trimmed(run), "word string, n long, ids binary")


def encoded_places(places: DataFrame, definition: str, kind: str) -> DataFrame:
    """``(key, size, spot, ids)`` for each row of ``places`` (key, size, spot, word).

    The rows are dealt and sorted by word, so that the distinct words, each followed by its places, are
    read in turn: a word is encoded once and joined to all its places, without a second exchange.
    No list of places is ever held; a word may have any number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(3))
            words = runs.values.to_pylist()
            fresh = words[1:] if words[0] == last else words
            ids = ([last_ids] if words[0] == last else []) + _encode(fresh, definition, kind).to_pylist()
            last, last_ids = words[-1], ids[-1]
            which = np.repeat(np.arange(len(words)), np.diff(np.r_[0, runs.run_ends.to_numpy()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()).take(pa.array(which))], ["key", "size", "spot", "ids"])

    return places.repartition("word").sortWithinPartitions("word").mapInArrow(trimmed(run), "key long, size int, spot int, ids binary")


def _through_words(docs: DataFrame, definition: str, id_col: str, text_col: str, schema: str, emit: Callable[[list, list[np.ndarray]], pa.RecordBatch], most: int) -> DataFrame:
    """Each row's ids in order, through ``emit(doc_ids, ids)``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Equal texts have equal words, so a text's hash and length may stand for it.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.char_length(text).alias("size"), text.alias("text"))
    spark = docs.sparkSession
    kind = "<u2" if max(_pieces(definition), default=0) < 1 << 16 else "<u4"
    often = stage(encoded_words(stage(frequent_words(texts, most), "bpe-frequent"), definition, kind), "bpe-frequent-ids")
    # Bounded: at most ``most`` words and their ids, the most frequent with the least numbers.
    held = often.toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns("n")
    sent = spark.sparkContext.broadcast(held["word"].combine_chunks())
    sizes = np.array([0, *map(len, held["ids"].to_pylist())]) // int(kind[2:])
    coded = spark.sparkContext.broadcast((b"".join(held["ids"].to_pylist()), sizes.astype(np.min_scalar_type(int(sizes.max())))))
    del held, sizes

    def looked_up(numbers: Numbers, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of all texts, their numbers, and where each text's words end."""
        each = [split_words(t) for t in texts]
        words = [w for ws in each for w in ws]
        return words, numbers.of(words), np.cumsum([len(ws) for ws in each])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        for whole in batches:
            met = set()
            for s in range(0, whole.num_rows, _SOME):
                fresh = []
                for row in zip(*(c.to_pylist() for c in whole.slice(s, _SOME).columns)):
                    if row[:2] not in met:
                        met.add(row[:2])
                        fresh.append(row)
                words, found, ends = looked_up(numbers, [t for _, _, t in fresh])
                at = np.flatnonzero(found == 0)
                text = np.searchsorted(ends, at, "right")
                keys, sizes = (pa.array([row[i] for row in fresh], kind).take(pa.array(text)) for i, kind in enumerate((pa.int64(), pa.int32())))
                spots = at - np.r_[0, ends][text]
                yield pa.RecordBatch.from_arrays([keys, sizes, pa.array(spots, pa.int32()), pa.array([words[i] for i in at.tolist()], pa.string())], ["key", "size", "spot", "word"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for s in range(0, whole.num_rows, _SOME):
                batch = whole.slice(s, _SOME)
                _, found, ends = looked_up(numbers, batch.column(3).to_pylist())
                out = [pack.compress(_squeezed(part)) for part in np.split(found, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "key", "size", "words"])

    places = texts.select("key", "size", "text").mapInArrow(trimmed(rare), _PLACES)
    # The same text in several batches gives the same places.
    # A place with its ids is one value, the place first, so that values sort by place.
    placed = F.concat(F.unhex(F.lpad(F.hex("spot"), 8, "0")), "ids").alias("placed")
    ids = encoded_places(places, definition, kind).select("key", "size", placed).groupBy("key", "size").agg(F.sort_array(F.collect_set("placed")).alias("rest"))
    rows = texts.mapInArrow(trimmed(numbered), "doc_id long, key long, size int, words binary").join(ids, ["key", "size"], "left").select("doc_id", "words", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        flat, lengths = np.frombuffer(coded.value[0], dtype=kind), coded.value[1].astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        for batch in batches:
            for s in range(0, batch.num_rows, _SOME):
                some = batch.slice(s, _SOME)
                out = []
                for packed, rest in zip(some.column(1), some.column(2)):
                    at = _values(unpack.decompress(packed.as_py()))
                    rest = [r[4:] for r in rest.as_py() or []]
                    own = np.frombuffer(b"".join(rest), dtype=kind)
                    size, start = lengths[at], begin[at]
                    missing = np.flatnonzero(at == 0)
                    if len(missing) != len(rest):
                        raise ValueError(f"{len(missing)} words wanted ids and {len(rest)} came")
                    more = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest)) // own.itemsize
                    size[missing], start[missing] = more, len(flat) + np.cumsum(more) - more
                    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    ids = np.empty(len(place), dtype=np.uint32)
                    inner = place < len(flat)
                    ids[inner], ids[~inner] = flat[place[inner]], own[place[~inner] - len(flat)]
                    out.append(ids)
                yield emit(some.column(0).to_pylist(), out)

    return rows.mapInArrow(trimmed(run), schema)


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT_WORDS) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs``.

    Null texts are empty and have no ids; repeated rows all stay; a text of any length is one row, encoded whole.
    Columns other than the two are ignored. An empty table gives no rows.
    """

    def emit(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _through_words(docs, definition, id_col, text_col, "doc_id long, ids array<int>", emit, most)


def pieces_table(spark: SparkSession, definition: str) -> DataFrame:
    """``(id, piece)``: the vocabulary and the added tokens; its size is the tokenizer's."""
    return spark.createDataFrame(sorted(_pieces(definition).items()), "id int, piece string")


def _pieces(definition: str) -> dict[int, str]:
    read = json.loads(definition)
    return {i: p for p, i in (read["model"]["vocab"] | {t["content"]: t["id"] for t in read["added_tokens"]}).items()}


def decode(encoded: DataFrame, pieces: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: each id joined to its piece, the pieces of a row put together with blanks, as a
    tokenizer without decoder does. Unknown ids give nothing; null and empty ids give an empty text.
    Rows that agree in both columns are decoded once and all returned."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).groupBy("doc_id", "ids").agg(F.count("*").alias("copies"))
    named = rows.select("doc_id", "ids", "copies", F.posexplode_outer("ids").alias("spot", "id")).join(pieces.select("id", "piece"), "id", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("spot", "piece")))), lambda x: x["piece"]), " ")
    whole = named.groupBy("doc_id", "ids", "copies").agg(text.alias("text"))
    return whole.select("doc_id", F.explode(F.array_repeat("text", F.col("copies").cast("int"))).alias("text"))


def digests(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT_WORDS) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: encodes, then decodes those ids.

    Null texts are empty (no tokens, digests of nothing); repeated rows all stay; texts of any length are taken whole;
    other columns are ignored; an empty table gives no rows. The id-to-piece join is made where the ids are, against the whole
    vocabulary, whose size is the tokenizer's: as rows, ids would shuffle several times the text (see :func:`decode`).
    """
    known = _pieces(definition)
    pieces = np.array([known.get(i, "") for i in range(max(known, default=-1) + 1)], dtype=object)

    def emit(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [
            pa.array(doc_ids, pa.int64()),
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(" ".join(pieces[i].tolist()).encode()).hexdigest() for i in ids], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _through_words(docs, definition, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", emit, most)
