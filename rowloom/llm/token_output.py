"""Token ids as Parquet: list columns with dictionary or delta encoding, controlled row groups and page indexes.

The texts are range-partitioned and sorted by id, tokenized in Arrow batches and written by Spark's Parquet writer, so
that files follow the order of the ids and a lost executor's files are simply written again. Metadata columns stand
beside the list column: a reader of ids or lengths never touches token pages, and a filter on the id reads only the
pages that the page index names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table, texts, tune

#: Latin letters (U+00C0 to U+024F but for three signs) that normalisation keeps and that have one lower-case letter.
PLAIN_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: Kinds of bytes: 0 separators, 1 letters, 2 signs and digits.
KINDS = np.full(256, 2, np.uint8)
KINDS[[0x20, 0x0A]] = 0
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Bytes that make a word odd: control characters, signs that can join letters to them, first bytes of other letters.
ODD = np.zeros(256, bool)
ODD[[*(b for b in range(0x20) if b != 0x0A), *b"'<", 0x7F, 0xC2, *range(0xCA, 0x100)]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Added tokens that only odd words hold, because of their first sign.
SPECIAL = re.compile(r"<\|[a-z]+\|>")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()

#: The parts of a tokenizers file under which a text may be encoded word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def splits_words(parts: dict) -> bool:
    """Whether the file has the parts of ``BY_WORDS``, a plain BPE model, and no added token but those that odd words hold."""
    model = parts["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "unk_token"))
    added = [t for t in parts["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not SPECIAL.fullmatch(t["content"])]
    return plain and not added and all(parts.get(k) == v for k, v in BY_WORDS.items())


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of words in UTF-8 bytes: their bytes in turn, ASCII in lower case, their first bytes there and in ``data``.

    A word between spaces and newlines falls into runs of letters and of signs; an odd word is one piece as it is.
    """
    kinds = KINDS[data]
    inside = kinds > 0
    new = inside.copy()
    new[1:] &= kinds[1:] != kinds[:-1]
    odd = np.flatnonzero(ODD[data])
    # the rest of what PLAIN_LETTERS leaves out: × and ÷, İ, and U+0250 on
    lead = np.flatnonzero((data == 0xC3) | (data == 0xC4) | (data == 0xC9))
    first, second = data[lead], data[lead + 1]
    other = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0) | (first == 0xC9) & (second >= 0x90)
    odd = np.concatenate([odd, lead[other]])
    lower = LOWER[data]
    if len(odd):
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        words = np.unique(np.searchsorted(edges[::2], odd, "right") - 1)
        steps = np.zeros(len(data) + 1, np.int8)
        steps[edges[2 * words]] = 1
        steps[edges[2 * words + 1]] = -1
        whole = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
        new &= ~whole
        new[edges[2 * words]] = True
        lower[whole] = data[whole]
    return lower[inside], np.flatnonzero(new[inside]), np.flatnonzero(new)


class WordEncoder:
    """Encodes texts with a tokenizers file; remembers the ids of the pieces of words between spaces and newlines.

    Only where the file's normalisation and splitting are those of ``BY_WORDS``, so that no token reaches over a space
    or newline, or from letters to signs or back but in an odd word: there, the ids of a text are those of its pieces
    in turn, and Latin letters need the BPE model alone. A block of texts is cut into pieces at once, and each of its
    different pieces is looked up once. At most ``most`` pieces of up to ``LONGEST`` bytes are kept, in two halves:
    when the newer one is full it takes the older one's place, and what is met again in the older one moves to the
    newer. Texts for any other file are encoded whole.
    """

    LONGEST = 64

    def __init__(self, path: str, most: int = 400_000, block: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.block = Tokenizer.from_file(path), most, block
        self.by_words = splits_words(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def kept(self, piece: bytes) -> bytes:
        """The ids of a piece that isn't among the newer ones; from now on it is."""
        if (got := self.older.get(piece)) is None:
            got = self.made(piece)
        if len(piece) <= self.LONGEST:
            if len(self.known) >= self.most // 2:
                self.known, self.older = {}, self.known
            self.known[piece] = got
        return got

    def made(self, piece: bytes) -> bytes:
        text = piece.decode()
        if piece.isalpha():  # ASCII
            ids = [t.id for t in self.model.tokenize(text.lower())]
        elif PLAIN_LETTERS.fullmatch(text):
            ids = [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def blocks(self, batch: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Numbers of texts and the texts, or parts of long ones that end before a separator: about ``block`` characters at once."""
        numbers, parts, size = [], [], 0
        for i, text in enumerate(batch):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > self.block:
                    end = max(text.rfind(s, at + 1, at + self.block) for s in " \n")
                    if end < 0:
                        end = min((e for s in " \n" if (e := text.find(s, at + self.block)) >= 0), default=len(text))
                if parts and size + end - at > self.block:
                    yield numbers, parts
                    numbers, parts, size = [], [], 0
                numbers.append(i), parts.append(text[at:end])
                size += end - at
                at = end
        if parts:
            yield numbers, parts

    def encode_block(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode() for p in parts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        joined, offsets, starts = cut_pieces(np.frombuffer(b"\n".join(raw), np.uint8))
        offsets = np.append(offsets, len(joined)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        which, different = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, different))
        if None in got:
            got = [self.kept(p) if g is None else g for p, g in zip(different, got, strict=True)]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        n = sizes[which]
        reached = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - reached[:-1], n) + np.arange(reached[-1])
        ids = np.frombuffer(b"".join(got), "<u4")[at].tobytes()
        bounds = [0, *(4 * reached[np.searchsorted(starts, ends)]).tolist()]
        return [ids[s:e] for s, e in pairwise(bounds)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]
        out = [[] for _ in batch]
        for numbers, parts in self.blocks(batch):
            for i, ids in zip(numbers, self.encode_block(parts), strict=True):
                out[i].append(ids)
        return [b"".join(ids) for ids in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def list_column(chunks: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(c) // 4 for c in chunks)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(chunks), dtype="<i4")))


def write_tokens(df: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, page_rows: int = 1000) -> None:
    """Encode every text (null: empty), append ``end_id`` and write them in ascending order of the id.

    Columns: ``part`` (number of the file in order), doc_id, ``local_start`` (ids before it in its file), n_tokens,
    tokens. ``encoding``: "dictionary" or "delta" for the tokens; the other numbers are monotone and take delta. Rows
    with equal ids are all written, in any order; null ids come first; an empty table gives no rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            chunks = [c + end for c in encoder(tokenizer).encode(b.column("text").to_pylist())]
            n = np.asarray([len(c) // 4 for c in chunks], dtype=np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), b.column("doc_id"), pa.array(starts), pa.array(n), list_column(chunks)], names=["part", "doc_id", "local_start", "n_tokens", "tokens"])

    ordered = texts(df, id_col, text_col).repartitionByRange(shuffle_partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    kind = df.schema[id_col].dataType.simpleString()
    ordered.mapInArrow(encode, f"part bigint, doc_id {kind}, local_start bigint, n_tokens bigint, tokens array<int>").write.options(**{
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
    }).parquet(path)


def with_starts(spark, path: str, rows: DataFrame) -> DataFrame:
    """Replaces ``part`` and ``local_start`` of rows of a token file by start (ids of all documents before it).

    Only the length columns are read for it: a sum for each file, then running sums over the files, which are joined.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), *[c for c in rows.columns if c not in ("part", "doc_id", "local_start")])


def read_tokens(spark, path: str, columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """doc_id, start, n_tokens and the given columns of a token file."""
    return with_starts(spark, path, spark.read.parquet(path).select("part", "doc_id", "local_start", "n_tokens", *columns))


def list_crc32(df: DataFrame, column: str = "tokens") -> DataFrame:
    """Replaces a list of ids by ids_crc32, the unsigned crc32 of them as little-endian unsigned 32-bit integers."""
    keep = [c for c in df.columns if c != column]

    def crc(batches):
        for b in batches:
            lists = b.column(column)
            values, offsets = np.asarray(lists.values).astype("<i4", copy=False), np.asarray(lists.offsets)
            crcs = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crcs, type=pa.int64())], names=[*keep, "ids_crc32"])

    return df.mapInArrow(crc, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", ids_crc32 bigint")


def op7_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .common import shared_path

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tune(spark)
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), str(tokenizer), path, end_id=2)
    return with_starts(spark, path, list_crc32(spark.read.parquet(path)))  # the ids stay out of the join
