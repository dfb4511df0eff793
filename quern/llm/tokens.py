"""Token ids as binary files: a static range asymmetric numeral system codes blocks of whole documents, each on its own, by the file's table of frequencies.

A file is its table, blocks and an index of blocks. A block has a directory of documents, the states of all lanes at checkpoints and a stream of
32-bit words that the lanes share. Ids are dealt out to the lanes in turn; a decoder may start at any checkpoint, and all checkpoints of a block are
decoded side by side. CRC-32 sums stand behind each block and for each stretch between checkpoints."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quern.llm.common import SLICE_BYTES, text_slices
from quern.sources.tables import materialize, scratch_dir

#: The vocabulary file, and the id behind each document.
VOCABULARY, END = "word_bpe_49k.json", 2
#: Frequencies of a table add up to 2 to this power, so it has at most so many ids; a table of all slots takes 4 MB.
SCALE = 20
#: States lie between 2 to the power 31 and 63 and move words of 32 bits.
LOW = np.uint64(1 << 31)
#: A block ends with the document that brings it to so many ids. It has at most LANES lanes, and a checkpoint every EVERY steps of all lanes.
BLOCK_IDS, LANES, EVERY = 1 << 20, 1024, 256
#: A file ends with the document that brings it to so many ids, which its task holds (64 MB), or with its task's range.
FILE_IDS = 1 << 24
#: Ids of so many words, and of as many pieces of words, are kept by a worker, in two generations; longer ones aren't. Together some 200 MB at most.
CACHED, LONG = 1 << 18, 48
#: Up to this character, upper and lower case, composition and classes are the same in every version of Unicode.
LATIN = "\u012f"
MAGIC = b"QIDS0001"
_BLOCK = "<IQIIQ"  # lanes, ids, documents, checkpoints, words
_INDEX = "<QQQQ"  # offset, bytes, ids, documents
_U64 = np.uint64


def normalized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 for each id that occurs, by largest remainders. Without any id, all are 0."""
    counts = counts.astype(np.float64)
    if not counts.any():
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError(f"a table has at most {1 << SCALE} ids")
    share = counts / counts.sum() * (1 << SCALE)
    out = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    left = (1 << SCALE) - int(out.sum())
    if left > 0:
        out[np.argsort(np.floor(share) - share, kind="stable")[:left]] += 1
    while left < 0:  # rare ids were lifted to 1: the frequent ones give
        most = np.argsort(-out, kind="stable")[: min(-left, int((out > 1).sum()))]
        out[most] -= 1
        left += len(most)
    return out


class Coder:
    """Codes ids by a table of frequencies (as many as there are ids, adding up to 2**SCALE)."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.filler = int(np.argmax(frequencies)) if len(frequencies) else 0

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Lanes; the states at each checkpoint (checkpoints x lanes); how many words lie before it; all words."""
        if len(ids) and (int(ids.max()) >= len(self.frequencies) or not self.frequencies[ids].all()):
            raise ValueError("an id has no frequency in the table")
        lanes = min(LANES, 1 << max(0, (len(ids) // 64).bit_length() - 1))
        steps = -(-len(ids) // lanes)
        grid = np.full(steps * lanes, self.filler, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, lanes)
        x = np.full(lanes, LOW)
        states = np.zeros((-(-steps // EVERY), lanes), np.uint64)
        chunks: list[np.ndarray] = []
        for t in range(steps - 1, -1, -1):
            f = self.frequencies[grid[t]]
            over = x >= f << _U64(63 - SCALE)
            chunks.append(x[over].astype(np.uint32))
            x = np.where(over, x >> _U64(32), x)
            q = x // f
            x = (q << _U64(SCALE)) + (x - q * f) + self.starts[grid[t]]
            if t % EVERY == 0:
                states[t // EVERY] = x
        chunks.reverse()
        before = np.cumsum([0, *map(len, chunks)])[:-1][::EVERY] if chunks else np.zeros(0, np.int64)
        return lanes, states, before.astype(np.uint64), np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)

    def decode(self, lanes: int, steps: int, states: np.ndarray, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The ids from some checkpoints on, EVERY steps each and all side by side: checkpoints x (EVERY * lanes). What lies behind the last step is of no meaning."""
        x, at = states.copy(), before.astype(np.int64)[:, None]
        out = np.zeros((min(steps, EVERY), *states.shape), np.uint32)
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        for t in range(len(out)):
            slot = x & _U64((1 << SCALE) - 1)
            out[t] = s = self.slots[slot]
            x = self.frequencies[s] * (x >> _U64(SCALE)) + slot - self.starts[s]
            short = x < LOW
            n = np.cumsum(short, axis=1)
            x = np.where(short, x << _U64(32) | words[np.minimum(at + n - 1, len(words) - 1)], x)
            at = at + n[:, -1:]
        return out.transpose(1, 0, 2).reshape(len(states), -1)


def packed(coder: Coder, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block of whole documents (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs])
    lanes, states, before, words = coder.encode(ids)
    sums = [zlib.crc32(ids[k : k + EVERY * lanes].astype("<u4")) for k in range(0, len(ids), EVERY * lanes)]
    directory = zlib.compress(
        np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes() + np.array([len(x) for _, x in docs], "<u8").tobytes(), 1)
    body = struct.pack(_BLOCK, lanes, len(ids), len(docs), len(states), len(words)) + struct.pack("<I", len(directory)) + directory
    body += states.astype("<u8").tobytes() + before.astype("<u8").tobytes() + np.array(sums, "<u4").tobytes() + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpacked(coder: Coder, data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, whether they are null, and lengths of a block's documents; the ids from checkpoint first up to last (all by default), and the place of the first one.

    A sum that doesn't fit raises ValueError."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block doesn't fit its checksum")
    lanes, n, docs, checkpoints, n_words = struct.unpack_from(_BLOCK, data)
    (size,) = struct.unpack_from("<I", data, struct.calcsize(_BLOCK))
    at = struct.calcsize(_BLOCK) + 4 + size
    directory = zlib.decompress(data[at - size : at])
    take = lambda kind, k, n: np.frombuffer(directory, kind, n, k)
    doc_ids, nulls, lengths = take("<i8", 0, docs), take("u1", 8 * docs, docs).astype(bool), take("<u8", 9 * docs, docs).astype(np.int64)
    states = np.frombuffer(data, "<u8", checkpoints * lanes, at).reshape(checkpoints, lanes)
    before = np.frombuffer(data, "<u8", checkpoints, at := at + states.nbytes)
    sums = np.frombuffer(data, "<u4", checkpoints, at := at + before.nbytes)
    words = np.frombuffer(data, "<u4", n_words, at + sums.nbytes)
    last = checkpoints if last is None else min(last, checkpoints)
    if first >= last:
        return doc_ids, nulls, lengths, np.zeros(0, np.uint32), first * EVERY * lanes
    rows = coder.decode(lanes, -(-n // lanes), states[first:last], before[first:last], words)
    ids = rows.reshape(-1)[: n - first * EVERY * lanes]
    for k in range(first, last):
        part = ids[(k - first) * EVERY * lanes : (k - first + 1) * EVERY * lanes]
        if zlib.crc32(part.astype("<u4")) != sums[k]:
            raise ValueError("ids don't fit their checksum")
    return doc_ids, nulls, lengths, ids, first * EVERY * lanes


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there. Paths without a scheme are local ones, as in tests."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Words:
    """The ids of words by the tokenizers library, kept for words that come again.

    The vocabulary's rules never join what stands on either side of ASCII white space: its pattern has no white space, and neither composition
    nor lower case looks across it. So a text's ids are those of its words, one after the other. Words of printable characters up to LATIN are
    in composed form as they are; they are put into lower case, matched by the vocabulary's own pattern, and each match goes to the library's
    model at once, once for all words that have it. Other words go through the whole library, and all do if the vocabulary has other rules."""

    def __init__(self, path: str, special: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        rules = json.loads(self.tokenizer.to_str())
        self.marked = [t["content"] for t in rules["added_tokens"]] if special else []
        steps = [x["type"] for part in ("normalizer", "pre_tokenizer") for x in (rules[part] or {}).get("normalizers") or (rules[part] or {}).get("pretokenizers") or []]
        known = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        self.pattern = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if known else None
        self.model, self.signs = self.tokenizer.model, {}
        if known:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            for c in map(chr, range(33, ord(LATIN) + 1)):
                self.signs.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.new = 0

    def piece(self, piece: str) -> bytes:
        """The ids of a match of the pattern."""
        if (ids := self.pieces.get(piece)) is None:
            if (ids := self.older_pieces.get(piece)) is None:
                signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
                ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
                self.new += 1
            if len(piece) <= LONG:
                if len(self.pieces) >= CACHED:
                    self.older_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        """The ids of a word that isn't at hand. It is kept if its pieces were known, that is, not at its first sight: most new words never come again."""
        if (ids := self.older.get(word)) is None:
            plain, self.new = word.decode(), 0
            if plain.isalpha() and self.pattern and (plain.isascii() or max(plain) <= LATIN):
                ids = self.piece(plain.lower())
            elif self.pattern and plain.isprintable() and plain and max(plain) <= LATIN and not any(x in plain for x in self.marked):
                ids = b"".join(map(self.piece, self.pattern.findall(plain.lower())))
            else:
                ids = array("I", self.tokenizer.encode(plain, add_special_tokens=False).ids).tobytes()
            if self.new or len(word) > LONG:
                return ids
        if len(self.recent) >= CACHED:
            self.older, self.recent = self.recent, {}
        self.recent[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, as 32-bit numbers, and where each text's start, with the end; none for nulls.

        Each word of the texts is looked up once; its ids are then put wherever it stands."""
        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        recent = self.recent
        own = [recent.get(w) or self.word(w) for w in found.dictionary.cast(pa.binary()).to_pylist()]
        flat, n = np.frombuffer(b"".join(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own)) // 4
        at = found.indices.to_numpy(zero_copy_only=False)
        counts = n[at]
        ends = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat((np.cumsum(n) - n)[at] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))]


@cache
def words(path: str, special: bool) -> Words:
    """One for a worker."""
    return Words(path, special)


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str | None, end: int, special: bool) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids, with the end id, of each row of batches (doc_id, text)."""
    own = words(vocabulary or public_tokenizers.path(VOCABULARY), special)
    for batch in batches:
        for first, last in text_slices(batch, "text", 8 * SLICE_BYTES):
            part = batch.slice(first, last - first)
            ids, at = own.encode(part.column("text"))
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                yield doc_id, np.append(ids[at[k] : at[k + 1]], np.uint32(end))


class File:
    """A file of ids being written: documents are gathered up to file_ids, then their frequencies are the table that all blocks of the file share."""

    def __init__(self, folder: str, file_no: int, file_ids: int, block_ids: int) -> None:
        self.folder, self.file_no, self.part_no, self.file_ids, self.block_ids = folder, file_no, 0, file_ids, block_ids
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids))
        self.size += len(ids)
        if self.size >= self.file_ids:
            yield from self.write()

    def write(self) -> Iterator[tuple]:
        """Write what is gathered; rows of the index. Nothing gathered makes no file."""
        if not self.docs:
            return
        counts = np.zeros(0, np.int64)
        for k in range(0, len(self.docs), 4096):
            part = np.bincount(np.concatenate([x for _, x in self.docs[k : k + 4096]]), minlength=len(counts))
            part[: len(counts)] += counts
            counts = part
        frequencies = normalized(counts)
        coder, name, index, own, size = Coder(frequencies), f"ids-{self.file_no:06d}-{self.part_no:04d}-{uuid.uuid4().hex}", [], [], 0
        store, at = place(self.folder)
        with store.open_output_stream(f"{at}/{name}") as out:
            table = zlib.compress(frequencies.astype("<u4").tobytes(), 1)
            out.write(MAGIC + struct.pack("<II", len(table), zlib.crc32(table)) + table)
            for k, (doc_id, ids) in enumerate(self.docs):
                own.append((doc_id, ids))
                size += len(ids)
                if size >= self.block_ids or k == len(self.docs) - 1:
                    data = packed(coder, own)
                    index.append((out.tell(), len(data), size, len(own)))
                    out.write(data)
                    own, size = [], 0
            out.write(b"".join(struct.pack(_INDEX, *x) for x in index) + struct.pack("<Q", len(index)) + MAGIC)
        yield from ((name, self.file_no, self.part_no, k, *x) for k, x in enumerate(index))
        self.docs, self.size, self.part_no = [], 0, self.part_no + 1


def write_ids(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END, special: bool = False, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text of df and write its ids to files in folder, in ascending id_col, null first; rows of one id by a hash of the text.

    Returns the index, a table of one row for each block: file, file_no, part_no, block_no, offset, bytes, ids, docs, start (ids of all blocks before).
    Texts are sorted by ranges of ids and read once; a task holds the ids of one file, whose frequencies its blocks share. Each try of a task
    writes files of its own name, and only those of the index count, so lost executors leave files that nothing reads at worst. Null and empty
    texts have the end id alone; a very long text is one block; an empty table gives an empty index. vocabulary: where each executor finds the
    file. special: whether strings of special tokens in a text count as those; else they are text. Other columns of df aren't read."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64("text")
    store, at = place(folder)
    store.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, index = File(folder, TaskContext.get().partitionId(), file_ids, block_ids), []
        for doc_id, ids in encoded(batches, vocabulary, end, special):
            index += file.add(doc_id, ids)
        index += file.write()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in index], kind) for k, kind in enumerate(kinds)], names)

    names = ["file", "file_no", "part_no", "block_no", "offset", "bytes", "ids", "docs"]
    ordered = docs.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    blocks = materialize(ordered.mapInArrow(run, "file string, file_no int, part_no int, block_no int, offset long, bytes long, ids long, docs long"))
    # One row for each task that wrote, then for each block of a task.
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = blocks.groupBy("file_no").agg(F.sum("ids").alias("ids")).select("file_no", before(W.orderBy("file_no")).alias("first"))
    placed = blocks.join(firsts, "file_no").withColumn("start", F.col("first") + before(W.partitionBy("file_no").orderBy("part_no", "block_no"))).drop("first")
    return materialize(placed)


@lru_cache(8)
def coder_of(folder: str, file: str) -> Coder:
    """The coder of a file's table; a worker keeps a few."""
    store, at = place(folder)
    with store.open_input_file(f"{at}/{file}") as f:
        head = f.read(len(MAGIC) + 8)
        size, check = struct.unpack("<II", head[len(MAGIC) :])
        table = f.read(size)
    if head[: len(MAGIC)] != MAGIC or zlib.crc32(table) != check:
        raise ValueError("a file's table of frequencies doesn't fit its checksum")
    return Coder(np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64))


def read_ids(index: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of each document in the files of an index of write_ids.

    Tasks take blocks, whatever file they lie in; one that doesn't fit its sums, or whose file's table doesn't, raises ValueError.
    ids_crc32 is of the ids as 32-bit numbers, least byte first. An empty index gives an empty table."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = place(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{at}/{r['file']}") as f:
                    f.seek(r["offset"])
                    doc_ids, nulls, lengths, ids, _ = unpacked(coder_of(folder, r["file"]), f.read(r["bytes"]))
                ends = np.cumsum(lengths)
                parts = ids.astype("<u4")
                sums = [zlib.crc32(parts[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(doc_ids, mask=nulls), pa.array(r["start"] + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.append(0, ends), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    # A block is a few MB of work, so each goes to a task of its own as far as there are partitions.
    dealt = index.select("file", "offset", "bytes", "start").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def file_blocks(data: bytes) -> list[tuple[int, int, int, int]]:
    """offset, bytes, ids and documents of each block of a whole file, from its own index."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a file of ids")
    end = len(data) - len(MAGIC) - 8
    (n,) = struct.unpack_from("<Q", data, end)
    return [struct.unpack_from(_INDEX, data, end - (n - k) * struct.calcsize(_INDEX)) for k in range(n)]


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in files of a new folder of the shared one, and what the files say of each document."""
    folder = f"{scratch_dir(spark)}-ids"
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder, with_ids=False)
