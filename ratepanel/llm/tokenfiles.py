"""Token ids in seekable files of independent zstandard frames.

Documents are range-partitioned and sorted by doc_id; each partition becomes one file:

* data frames: zstandard, each independent and with its own content checksum, of the
  little-endian unsigned 32-bit ids of consecutive documents, ``FRAME_BYTES`` or a little
  more; longer documents are spread over several frames;
* a skippable frame with the documents' ids and lengths, itself compressed;
* the seek table, a trailing skippable frame with each data frame's sizes and checksum
  (the low 32 bits of XXH64 of its content).

A reader finds the table from the file's last nine bytes and decompresses only frames
that hold what it was asked for, checking each. Any zstandard tool reads the plain ids.

A text is encoded word by word, each distinct word once for some chunks of text: the
pre-tokenizer never joins across a single space before a non-space, a line break between
words, or from letters to marks, so this equals encoding it whole.

Files are written through ``pyarrow.fs`` into the shared folder under names of their
own for each task attempt; the manifest that Spark commits names the attempts that count, so
lost executors and repeated tasks leave no wrong file in it.

Defined results: null texts are empty documents of one id, the end; null doc_ids come
first; rows with equal doc_id follow each other in the order of their texts' hashes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.llm.common import chunks
from ratepanel.session import settle, shared_folder

FRAME_BYTES = 262_144
LEVEL = 3
CHUNK_BYTES = 16_000_000
MEMO = 300_000
END = 2

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

MARKS = ".,;:!?*&%$#|()[]{}-+=/"

# Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others,
# in order, are the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
SPACE = chr(ALPHABET[32])

NOT_HELD = b"?"

UNSAFE = re.compile(r" \s")
UNSAFE_LINE = re.compile(r"\n(?:(?<=\s\n)|[^\S ]| $)")
WHITE = re.compile(r"\s")
BEFORE_WORD = re.compile(r" (?=\S)")


def gathered(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``tokens``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(tokens)) < 2**31 else np.int64
    places = np.repeat((starts - ends + sizes).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return tokens[places]


class Stems:
    """Words and their ids, all in one array; row 0 is for words that have none here."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.tokens = np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def ids(self, row: int) -> bytes:
        """The ids of a row; ``NOT_HELD`` for -1."""
        return NOT_HELD if row < 0 else self.tokens[self.starts[row] : self.starts[row] + self.sizes[row]].tobytes()

    def add(self, words: list[str], packed: list[bytes | None]) -> np.ndarray:
        """New words with their ids; their rows."""
        known = [ids for ids in packed if ids is not None]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        rows = np.zeros(len(words), np.int64)
        rows[[ids is not None for ids in packed]] = np.arange(len(known)) + len(self.sizes)
        self.rows.update(zip(words, rows.tolist()))
        self.starts = np.concatenate((self.starts, len(self.tokens) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.tokens = np.concatenate((self.tokens, np.frombuffer(b"".join(known), "<u4")))
        return rows


class Encoder:
    """Texts to the bytes of their ids, by memos of words.

    Holds for byte-level tokenizers that split by the usual pattern, in which letters,
    digits, other marks and white space never share a token; any other definition encodes
    texts whole.
    """

    def __init__(self, definition: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        parsed = json.loads(definition)
        splits = parsed.get("pre_tokenizer") or {}
        usual = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
        added = [t["content"] for t in parsed.get("added_tokens", [])]
        apart = all(any(not c.isalpha() and c not in MARKS and not c.isspace() for c in t) for t in added)
        self.by_word = usual and not parsed.get("normalizer") and apart and not any(WHITE.search(t) for t in added)
        # Ids of letters in texts that Arrow splits: of the last chunks, and of those before them.
        self.stems, self.before = Stems(), Stems()
        # Of letters in other texts, by whether a space comes before.
        self.recent: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.older: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.others: dict[tuple[bool, str], bytes] = {}
        self.end = struct.pack("<I", end)
        self.line = self._whole("\n")

    @classmethod
    def of_worker(cls, definition: str, end: int) -> Encoder:
        """The Python worker's own encoder, kept from task to task."""
        key = (xxhash.xxh64_intdigest(definition), end)
        if key not in KEPT:
            KEPT[key] = cls(definition, end)
        return KEPT[key]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str, spaced: bool) -> bytes:
        """Letters alone are one piece for the model, which takes bytes as characters of its alphabet."""
        ids = self.recent[spaced].get(word)
        if ids is None:
            ids = self.older[spaced].get(word)
            if ids is None:
                piece = " " + word if spaced else word
                piece = piece.replace(" ", SPACE) if word.isascii() else piece.encode().decode("latin-1").translate(ALPHABET)
                found = [t.id for t in self.model.tokenize(piece)]
                ids = struct.pack(f"<{len(found)}I", *found)
            self.recent[spaced][word] = ids
        return ids

    def _other(self, word: str, spaced: bool) -> bytes:
        ids = self.others.get((spaced, word))
        if ids is None:
            if len(self.others) > MEMO:
                self.others.clear()
            ids = self.others[spaced, word] = self._whole(" " + word if spaced else word)
        return ids

    def _word(self, word: str, spaced: bool) -> bytes:
        """A word without white space: its letters and the marks after them, if it is no more than that."""
        letters = word.rstrip(MARKS)
        if not letters.isalpha():
            return self._other(word, spaced)
        ids = self._letters(letters, spaced)
        return ids if len(letters) == len(word) else ids + self._other(word[len(letters) :], False)

    def _odd(self, word: str, spaced: bool) -> bytes:
        """A word that may hold white space."""
        if WHITE.search(word) is None:
            return self._word(word, spaced)
        lines = word.split("\n")
        if all(lines) and not any(map(WHITE.search, lines)):
            return self.line.join([self._word(x, spaced and not i) for i, x in enumerate(lines)])
        return self._other(word, spaced)

    def _stem(self, stem: str) -> bytes | None:
        """The ids of letters alone, after a line break if they begin with one; none of anything else."""
        spaced = stem[:1] != "\n"
        letters = stem if spaced else stem[1:]
        if not letters.isalpha():
            return None
        if letters.isascii():
            ids = [t.id for t in self.model.tokenize(SPACE + letters if spaced else letters)]
        else:
            ids = [t.id for t in self.model.tokenize((" " + letters if spaced else letters).encode().decode("latin-1").translate(ALPHABET))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed if spaced else self.line + packed

    def _rows(self, stems: list[str]) -> np.ndarray:
        """The places of distinct stems in ``stems``, the table of the last chunks; 0 if more than letters."""
        if len(self.stems.rows) > MEMO:
            self.before, self.stems = self.stems, Stems()
        rows = np.fromiter(map(self.stems.rows.get, stems, repeat(-1)), np.int64, len(stems))
        missing = np.flatnonzero(rows < 0)
        names = [stems[i] for i in missing.tolist()]
        packed = [self.before.ids(row) if row else None for row in map(self.before.rows.get, names, repeat(-1))]
        packed = [self._stem(name) if ids == NOT_HELD else ids for name, ids in zip(names, packed)]
        rows[missing] = self.stems.add(names, packed)
        return rows

    def _apart(self, text: str) -> bytes:
        """A text in which white space meets white space."""
        for kind in (True, False):
            if len(self.recent[kind]) > MEMO:
                self.older[kind], self.recent[kind] = self.recent[kind], {}
        first, *later = BEFORE_WORD.split(text)
        return b"".join((self._odd(first, False), *[self._odd(word, True) for word in later], self.end))

    def _together(self, texts: list[str]) -> list[bytes]:
        """Texts with nothing but single spaces and line breaks between words; Arrow splits them, names the
        distinct words, those after a line break with the break before them, and parts them from the marks at
        their end. So is the first word of a text, whose break is then left out."""
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        nothing, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        split = pc.split_pattern(pc.binary_join_element_wise(line, lines, nothing), " ")
        words, stops = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:]
        del lines, split
        names = words.dictionary
        letters = pc.utf8_rtrim(names, MARKS)
        cut = pc.subtract(pc.binary_length(names), pc.binary_length(letters)).to_numpy()
        letters = letters.dictionary_encode()
        rows = self._rows(letters.dictionary.to_pylist())[letters.indices.to_numpy()]
        # Of each name what follows its letters: nothing, marks, or all of a name that is more than letters and marks.
        after, pieces = np.zeros(len(names), np.int64), [b""]
        odd = np.flatnonzero(rows == 0)
        after[odd] = np.arange(1, len(odd) + 1)
        for name in names.take(pa.array(odd)).to_pylist():
            pieces.append(self.line + self._odd(name[1:], False) if name[:1] == "\n" else self._odd(name, True))
        marked = np.flatnonzero((rows > 0) & (cut > 0))
        marks = [name[-n:] for name, n in zip(names.take(pa.array(marked)).to_pylist(), cut[marked].tolist())]
        number = {m: i for i, m in enumerate(dict.fromkeys(marks), start=len(pieces))}
        after[marked] = np.fromiter(map(number.get, marks), np.int64, len(marks))
        pieces += [self._other(m, False) for m in number]
        more = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin = len(self.stems.tokens) + np.cumsum(more) - more
        tokens = np.concatenate((self.stems.tokens, np.frombuffer(b"".join(pieces), "<u4")))
        sizes = np.stack((self.stems.sizes[rows], more[after]), axis=1)
        tokens = gathered(tokens, np.stack((self.stems.starts[rows], begin[after]), axis=1).ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1)
        which = words.indices.to_numpy()
        taken = sizes[which]
        tokens = gathered(tokens, (np.cumsum(sizes) - sizes)[which], taken)
        ends = np.cumsum(taken)[stops - 1]
        begins = np.r_[0, ends[:-1]] + len(self.line) // 4
        return [tokens[a:b].tobytes() + self.end for a, b in zip(begins, ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) + self.end for t in texts]
        apart = [bool(UNSAFE.search(t) or UNSAFE_LINE.search(t)) for t in texts]
        plain = [t for t, a in zip(texts, apart) if not a]
        found = iter(self._together(plain) if plain else ())
        return [self._apart(t) if a else next(found) for t, a in zip(texts, apart)]


KEPT: dict[tuple[int, int], Encoder] = {}


class Writer:
    """One file, document by document."""

    def __init__(self, out):
        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.waiting = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting += ids
        while len(self.waiting) >= FRAME_BYTES:
            self._frame(FRAME_BYTES)

    def _frame(self, size: int) -> None:
        data = bytes(self.waiting[:size])
        del self.waiting[:size]
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(len(self.waiting))
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        lengths = np.array(self.lengths, dtype="<i8")
        index = self.compressor.compress(struct.pack("<Q", len(ids)) + known.tobytes() + ids.tobytes() + lengths.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


@dataclass
class Reader:
    """Random access to the documents of one file."""

    source: object
    doc_ids: list[int | None]
    lengths: np.ndarray
    packed: np.ndarray
    plain: np.ndarray
    checks: np.ndarray

    @classmethod
    def open(cls, source) -> Reader:
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        at = int(table[:, 0].sum())
        source.seek(at)
        magic, length = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no index of documents")
        index = zstandard.ZstdDecompressor().decompress(source.read(length))
        (docs,) = struct.unpack_from("<Q", index)
        known = np.frombuffer(index, np.uint8, docs, 8)
        ids = np.frombuffer(index, "<i8", docs, 8 + docs)
        lengths = np.frombuffer(index, "<i8", docs, 8 + 9 * docs)
        return cls(source, [int(i) if k else None for i, k in zip(ids, known)], lengths, table[:, 0], table[:, 1], table[:, 2])

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """The places in the file, ascending, and the id bytes of the wanted documents (all, if none are named)."""
        ends = np.cumsum(self.lengths) * 4
        edges = np.r_[0, np.cumsum(self.plain)]
        offsets = np.r_[0, np.cumsum(self.packed)]
        held: tuple[int, bytes] = (-1, b"")
        for doc in sorted(wanted) if wanted is not None else range(len(self.lengths)):
            stop = int(ends[doc])
            start = stop - int(self.lengths[doc]) * 4
            parts = []
            frame = int(np.searchsorted(edges, start, side="right")) - 1
            while start < stop:
                if held[0] != frame:
                    held = (frame, self._content(frame, int(offsets[frame])))
                upto = min(stop, int(edges[frame + 1]))
                parts.append(held[1][start - int(edges[frame]) : upto - int(edges[frame])])
                start, frame = upto, frame + 1
            yield doc, b"".join(parts)

    def _content(self, frame: int, offset: int) -> bytes:
        self.source.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.packed[frame])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[frame]:
            raise ValueError(f"frame {frame} is damaged")
        return data


def location(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes all documents; the manifest ``part, path, docs, tokens, start`` in file order.

    ``tokenizer`` is the path of a tokenizers definition on the driver.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{os.path.abspath(folder)}"
    with open(tokenizer, encoding="utf-8") as source:
        definition = spark.sparkContext.broadcast(source.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        writer, out, encoder = None, None, None
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK_BYTES):
                if not batch.num_rows:
                    continue
                if writer is None:
                    system, path = location(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    writer, encoder = Writer(out), Encoder.of_worker(definition.value, end)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            values = [task.partitionId(), name, len(writer.lengths), sum(writer.lengths)]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "docs", "tokens"), values))])

    order = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = settle(ranged.mapInArrow(run, "part long, path string, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = location(row["path"])
                with system.open_input_file(path) as source:
                    reader = Reader.open(source)
                    sums = [zlib.crc32(ids) for _, ids in reader.documents()]
                starts = row["start"] + np.cumsum(reader.lengths) - reader.lengths
                columns = [pa.array(reader.doc_ids, pa.int64()), pa.array(starts), pa.array(reader.lengths), pa.array(sums, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, doc_ids: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The ids of a few documents, straight from the files; only their frames are decompressed."""
    for row in manifest.orderBy("part").toLocalIterator():
        system, path = location(row["path"])
        with system.open_input_file(path) as source:
            reader = Reader.open(source)
            wanted = [i for i, d in enumerate(reader.doc_ids) if d in doc_ids]
            for place, ids in reader.documents(wanted):
                yield reader.doc_ids[place], np.frombuffer(ids, dtype="<u4")
