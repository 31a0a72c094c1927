"""Token ids in binary files: each document compressed on its own with a shared zstandard dictionary.

A file holds, one after the other: the magic bytes; the SHA-256 of the dictionary (32 bytes); the
compressed documents; the index, one entry of INDEX for each document; and the tail, TAIL:
where the index begins and how many entries it has. A document's ids are little-endian unsigned
32-bit integers. The dictionary lies beside the files as `dictionary`. To read one document, read the
tail, find the entry and read its bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, hash_sample, texts_of, tidy, written

MAGIC = b"TOKIDS01"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
TAIL = np.dtype([("index_at", "<u8"), ("entries", "<u8")])
#: The dictionary: its size, and how many texts of what length at most it is trained on.
DICTIONARY_BYTES, SAMPLE_TEXTS, SAMPLE_BYTES = 65_536, 600, 16_384
#: Encoded words that a worker remembers before it starts anew.
CACHE_WORDS = 500_000
DOCS_PER_FILE = 16_384
#: Texts are encoded together up to so many bytes.
ENCODE_BYTES = 4_000_000


def _filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


#: Letters that no normal form and no lower-casing changes.
_SMALL_LETTERS = "".join(c for c in map(chr, range(97, 256)) if c.isalpha() and c.islower() and c not in "ªµº")
_SMALL_WORD = re.compile(f"[{_SMALL_LETTERS}]+")


def _byte_spelling(tokenizer) -> dict[int, str]:
    """How a byte-level tokenizer writes each byte; empty for other tokenizers."""
    from tokenizers import pre_tokenizers

    step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {b: step.pre_tokenize_str(c)[0][0] for c in _SMALL_LETTERS if len(c.encode()) == 2 for b in [c.encode()]}
    out = {}
    for two, text in letters.items():
        if len(text) != 2:
            return {}
        out |= dict(zip(two, text, strict=True))
    return out


class WordEncoder:
    """Encodes texts by their distinct words, and remembers words.

    It needs a tokenizer of which no token reaches over ASCII white space, as where white space is dropped. Where
    case makes no difference, or punctuation after a letter is always a token of its own, fewer words are encoded. Words
    of small Latin letters go to the tokenizer's model alone, where its other steps leave them as they are, but
    for the bytes that its vocabulary writes as other characters.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known: dict[bytes, bytes] = {b"": b""}
        upper, lower, both, marks = (self._ids_of(x) for x in ("AN EXAMPLE", "an example", "an example.,", ".,"))
        self.any_case = upper == lower
        self.marks = ".,;:!?" if both == lower + marks else ""
        self.spelling = _byte_spelling(self.tokenizer)
        probes = [*_SMALL_LETTERS, _SMALL_LETTERS, _SMALL_LETTERS[::-1], "example", "été"]
        self.plain = bool(self.spelling) and all(self._ids_of(w) == self._model_ids(w.encode()) for w in probes)

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model_ids(self, word: bytes) -> list[int]:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.spelling)
        return [t.id for t in self.model.tokenize(text)]

    def _is_plain(self, word: bytes) -> bool:
        return word.isalpha() and word.islower() or not word.isascii() and _SMALL_WORD.fullmatch(word.decode("utf-8", "replace")) is not None

    def _learn(self, words: list[bytes]) -> None:
        """Encode words as one text, which costs less than a call each, and cut its ids where words begin."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.zeros(len(texts), dtype=np.int64)
        np.cumsum([len(x) + 1 for x in texts[:-1]], out=begins[1:])
        word = np.searchsorted(begins, np.array([a for a, _ in found.offsets], dtype=np.int64), side="right") - 1
        self._remember(words, found.ids, np.searchsorted(word, np.arange(len(texts) + 1)))

    def _learn_plain(self, words: list[bytes]) -> None:
        ids, ends = [], [0]
        for w in words:
            ids += self._model_ids(w)
            ends.append(len(ids))
        self._remember(words, ids, np.array(ends))

    def _remember(self, words: list[bytes], ids: list[int], cuts: np.ndarray) -> None:
        data, cuts = np.array(ids, dtype="<u4").tobytes(), (4 * cuts).tolist()
        self.known.update((w, data[i:j]) for w, i, j in zip(words, cuts[:-1], cuts[1:], strict=True))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.known = {b"": b""}
            missing = [i for i, w in enumerate(words) if w]
        plain, other = [], []
        for i in missing:
            (plain if self.plain and self._is_plain(words[i]) else other).append(words[i])
        self._learn_plain(plain)
        for i in range(0, len(other), 20_000):
            self._learn(other[i : i + 20_000])
        for i in missing:
            found[i] = self.known[words[i]]
        return found

    def _ids(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words; marks behind a letter are looked up on their own."""
        if not self.marks:
            return self._look_up(words.cast(pa.binary()).to_pylist())
        stems = pc.ascii_rtrim(words, self.marks)
        ends = np.frombuffer(stems.buffers()[1], np.int32)[stems.offset : stems.offset + len(stems) + 1][1:]
        begins = np.frombuffer(stems.buffers()[1], np.int32)[stems.offset : stems.offset + len(stems)]
        last = np.zeros(len(stems), dtype=np.uint8)
        last[ends > begins] = np.frombuffer(stems.buffers()[2], np.uint8)[ends[ends > begins] - 1]
        lower = last | 32
        letter = (lower >= 97) & (lower <= 122)
        cut = pc.binary_length(stems).to_numpy(zero_copy_only=False) < pc.binary_length(words).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(cut & (last > 127)).tolist():
            letter[i] = stems[i].as_buffer().to_pybytes().decode("utf-8", "replace")[-1:].isalpha()
        cut &= letter
        distinct = pc.if_else(pa.array(cut), stems, words).dictionary_encode()
        ids = self._look_up(distinct.dictionary.cast(pa.binary()).to_pylist())
        at = distinct.indices.to_numpy()
        out = [ids[i] for i in at.tolist()]
        marked = np.flatnonzero(cut)
        whole = words.take(pa.array(marked)).cast(pa.binary()).to_pylist()
        lengths = (ends - begins)[marked].tolist()
        marks = [w[n:] for w, n in zip(whole, lengths, strict=True)]
        of = dict(zip(every := list(dict.fromkeys(marks)), self._look_up(every), strict=True))
        for i, m in zip(marked.tolist(), marks, strict=True):
            out[i] += of[m]
        return out

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and where each text's ids end (in tokens)."""
        if self.any_case:  # special tokens are written with <| and know case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)
        distinct = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        places = distinct.indices.to_numpy()
        ids = [*self._ids(distinct.dictionary), self.end]
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        ends = offsets[1:] - offsets[0] + np.arange(len(texts))
        order = np.full(len(places) + len(texts), len(ids) - 1, dtype=np.int32)
        rest = np.ones(len(order), dtype=bool)
        rest[ends] = False
        order[rest] = places
        size = sizes[order]
        # ENCODE_BYTES of texts, or one text, have fewer than 2^31 tokens
        stops = np.cumsum(size, dtype=np.int32)
        at = np.repeat(starts[order] - (stops - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return np.frombuffer(b"".join(ids), dtype="<u4")[at].tobytes(), stops[ends].astype(np.int64)

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, ends = self.encode(texts)
        cuts = [0, *(4 * ends).tolist()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where the samples are too few to train one, their raw content; none: b''."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encode every whole text and write the ids into files under `out`, in ascending doc_id order.

    docs: doc_id, text; other columns are ignored. A null text counts as empty: its ids are the end
    id alone. A null doc_id comes first; rows that repeat an id are all written. The dictionary is trained
    on at most SAMPLE_TEXTS texts of at most SAMPLE_BYTES bytes (least hash of id and size first), everything else
    reads all texts. Returns the manifest: file (its place in the order), path, docs, tokens. A file
    gets its name when it is complete, so that a task that is lost and run again does no harm. An
    empty table gives no files.
    """
    spark = docs.sparkSession
    texts = texts_of(docs).fillna("", ["text"])
    sized = texts.withColumn("size", F.octet_length("text")).where(F.col("size").between(1, SAMPLE_BYTES))
    sample = hash_sample(sized, docs.count(), SAMPLE_TEXTS, "doc_id", "size", ties="text")
    encoder = WordEncoder(tokenizer, end_id)
    dictionary = train_dictionary(encoder.encode_each(pa.array([r.text for r in sample.collect()], pa.string())))
    del encoder
    give_back()
    filesystem, root = _filesystem(out)
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, end_id)
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared.value))
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                part = batch.slice(start, max(1, int(np.searchsorted(ends, done + ENCODE_BYTES, side="right")) - start))
                start += part.num_rows
                encoded = encoder.encode_each(part.column("text"))
                sizes = [len(ids) // 4 for ids in encoded]
                packed = [packer.compress(ids) for ids in encoded]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(out)
        number = TaskContext.get().partitionId()
        name, own = f"{root}/part-{number:06d}.tok", f"{root}/.{uuid.uuid4().hex}"
        index, at = [], len(MAGIC) + 32
        stream = None
        for batch in batches:
            if stream is None and batch.num_rows:
                stream = filesystem.open_output_stream(own)
                stream.write(MAGIC + hashlib.sha256(shared.value).digest())
            part = np.zeros(batch.num_rows, dtype=INDEX)
            part["doc_id"] = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
            part["has_id"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            part["n_tokens"] = batch.column("n_tokens").to_numpy()
            part["size"] = pc.binary_length(batch.column("packed")).to_numpy()
            part["offset"] = at + np.cumsum(part["size"], dtype=np.uint64) - part["size"]
            index.append(part)
            at += int(part["size"].sum(dtype=np.uint64))
            for packed in batch.column("packed"):
                stream.write(packed.as_buffer())
        if stream is None:
            return
        whole = np.concatenate(index)
        stream.write(whole.tobytes() + np.array([(at, len(whole))], dtype=TAIL).tobytes())
        stream.close()
        filesystem.move(own, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([name]), pa.array([len(whole)], pa.int64()), pa.array([int(whole["n_tokens"].sum(dtype=np.int64))], pa.int64())], ["file", "path", "docs", "tokens"]
        )

    packed = written(texts.mapInArrow(tidy(encode), "doc_id long, n_tokens long, packed binary"), "packed")
    files = max(1, -(-packed.count() // docs_per_file))
    ordered = packed.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "n_tokens", F.crc32("packed")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", F.crc32("packed"))
    manifest = written(ordered.mapInArrow(write, "file int, path string, docs long, tokens long"), "manifest")
    discard(packed)
    return manifest


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """Read every document of the files: doc_id, start, n_tokens, ids_crc32.

    start: number of ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit
    integers. The running sum goes over the manifest, a row for each file.
    """
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(out)
        dictionary = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with filesystem.open_input_file(path) as f:
                    if dictionary is None:
                        dictionary = filesystem.open_input_file(f"{root}/dictionary").read()
                    if f.read(len(MAGIC)) != MAGIC or f.read(32) != hashlib.sha256(dictionary).digest():
                        raise ValueError(f"{path} is no token file, or was written with another dictionary")
                    f.seek(f.size() - TAIL.itemsize)
                    tail = np.frombuffer(f.read(), dtype=TAIL)[0]
                    f.seek(int(tail["index_at"]))
                    index = np.frombuffer(f.read(int(tail["entries"]) * INDEX.itemsize), dtype=INDEX)
                    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
                    for a in range(0, len(index), 1024):
                        part = index[a : a + 1024]
                        sums, counts = [], []
                        f.seek(int(part["offset"][0]))
                        for size in part["size"]:
                            ids = opener.decompress(f.read(int(size)))
                            sums.append(zlib.crc32(ids))
                            counts.append(len(ids) // 4)
                        n = np.array(counts, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=part["has_id"] == 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                        )
                        start += int(n.sum())

    n = max(1, manifest.count())
    return placed.select("file", "path", "start").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(path: str, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of all documents of this id in one file, reading no others."""
    filesystem, root = _filesystem(out)
    with filesystem.open_input_file(f"{root}/dictionary") as f:
        dictionary = f.read()
    with filesystem.open_input_file(path) as f:
        f.seek(f.size() - TAIL.itemsize)
        tail = np.frombuffer(f.read(), dtype=TAIL)[0]
        f.seek(int(tail["index_at"]))
        index = np.frombuffer(f.read(int(tail["entries"]) * INDEX.itemsize), dtype=INDEX)
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        found = []
        for entry in index[(index["doc_id"] == doc_id) & (index["has_id"] == 1)]:
            f.seek(int(entry["offset"]))
            found.append(np.frombuffer(opener.decompress(f.read(int(entry["size"]))), dtype="<u4"))
        return found
