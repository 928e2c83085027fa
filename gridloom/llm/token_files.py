"""Token ids in binary files with Elias-Fano document boundaries.

A file holds, one after another: 8 bytes `MAGIC`, the length of the header as 32 bits, the header as JSON, the ids of its
documents as 16-bit numbers (32-bit if the vocabulary needs it), the Elias-Fano code of the places where documents end,
and the Elias-Fano code of the ascending doc_ids. Numbers are little-endian. Files continue each other; the manifest, a
Parquet table beside them, has one row per file with its place in the order, the ids before it and its first and last
document.

Rows are dealt into ranges of doc_id, so each task writes its own files. Every attempt writes under a new name, and only
the manifest, which Spark commits once per task, says which files count: a lost executor or a second attempt leaves at
most files that nobody reads.

Where white space always ends a token and is dropped, as `splits_at_spaces` reads from the tokenizer's own settings, the
ids of a text are those of its words in a row; each worker then encodes a word, or the letters and signs in it, once and
remembers them, and Arrow and numpy cut the texts and put the ids together.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from gridloom.llm.elias_fano import EliasFano, encode

MAGIC = b"IDFILE01"
END_ID = 2
#: Ids after which a task starts a new file, and documents read at once; both bound memory.
FILE_IDS, READ_DOCS = 16_000_000, 2_000
READ_IDS = 4_000_000
#: Bytes of parts of words and ids that a worker remembers, at about so many an entry; beyond, it starts anew.
REMEMBERED, ENTRY = 240_000_000, 140
#: Bytes of texts encoded together; a longer text is encoded by stretches of at least so many code points.
TOGETHER = 3_000_000
MANIFEST = "part int, file_no int, path string, n_docs long, n_ids long, first_doc long, last_doc long"


def _parts(settings: dict | None, inner: str) -> list[dict]:
    return [] if settings is None else settings[inner] if settings["type"] == "Sequence" else [settings]


def splits_at_spaces(settings: dict) -> bool:
    """Whether encoding a text word by word is proven to give the same ids: the parts of the tokenizer are known ones."""
    for n in _parts(settings["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "NFD", "Lowercase") and (n["type"], n.get("pattern"), n.get("content")) != ("Replace", {"Regex": "\\s+"}, " "):
            return False
    pre = _parts(settings["pre_tokenizer"], "pretokenizers")
    if not pre or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or " " in a["content"] or "\n" in a["content"] for a in settings["added_tokens"]):
        return False
    words = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # no branch can match white space
    if (pre[0]["type"], pre[0].get("pattern"), pre[0].get("behavior"), pre[0].get("invert")) != ("Split", {"Regex": words}, "Removed", True):
        return False
    return all((p["type"], p.get("add_prefix_space")) == ("ByteLevel", False) for p in pre[1:]) and not settings["truncation"] and not settings["padding"]


#: Letters that stay single letters under NFC and lower-casing.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
LETTERS = re.compile(f"[{LATIN}]+")
PARTS = re.compile(f"[{LATIN}]+|[^{LATIN}]+")
GAP = re.compile("[ \n]")
#: Kinds of UTF-8 bytes: between words, in `LATIN`, ASCII signs but the apostrophe; words with others are encoded as they are.
SPACE, LETTER, SIGN, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[ord(" "), ord("\n")]] = SPACE
KINDS[ord("!") : ord("~") + 1] = SIGN
KINDS[ord("'")] = OTHER
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KINDS[0x80:0xC0] = KINDS[0xC3:0xC9] = LETTER  # U+00C0 to U+023F begin with C3 to C8
#: Two signs and a letter that lower-casing takes apart lie among them.
NO_LETTERS = [(0xC3, [0x97, 0xB7]), (0xC4, [0xB0])]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Encoder:
    """Ids of texts as bytes, `dtype` numbers with the end id last.

    A word of Latin letters and ASCII signs is cut further, since a run of letters is always a unit of its own. Numpy finds
    these parts among the bytes of many texts, Arrow counts equal ones once, and only parts not seen before are encoded: runs
    of letters, which the pre-tokenizer would leave whole, by the tokenizer's model, all others by the tokenizer.
    """

    def __init__(self, settings: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(settings)
        top = max([*self.tokenizer.get_vocab(with_added_tokens=True).values(), end_id or 0])
        self.dtype = "<u2" if top < 2**16 else "<u4"
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        info = json.loads(settings)
        self.added = [a["content"] for a in info["added_tokens"]]
        # an added token that is one part would be found in what was cut or lower-cased
        self.by_word = splits_at_spaces(info) and all(len(PARTS.findall(a)) > 1 for a in self.added)
        self.marked = re.compile("|".join(map(re.escape, self.added)).encode())
        self.lowered = any(n["type"] == "Lowercase" for n in _parts(info["normalizer"], "normalizers"))
        self.byte_levels = [ByteLevel(add_prefix_space=False, use_regex=False)] * (len(_parts(info["pre_tokenizer"], "pretokenizers")) - 1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # parts and their places in `ids`
        self.ids = pa.array([], pa.large_binary())
        self.size = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _spelled(self, runs: list[str]) -> list[str]:
        """Runs of letters as the model reads them."""
        text = " ".join(runs)
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        gap = " "
        for level in self.byte_levels:
            text, gap = ("".join(piece for piece, _ in level.pre_tokenize_str(t)) for t in (text, gap))
        return text.split(gap)

    def _learn(self, parts: list[bytes]) -> None:
        texts = b" ".join(parts).decode().split(" ")
        runs = [t for t in texts if not t.isascii() and LETTERS.fullmatch(t)]
        spelled = dict(zip(runs, self._spelled(runs), strict=True)) if runs else {}
        others = [t for t in texts if not (t.isascii() and t.isalpha()) and t not in spelled]
        ids = dict(zip(others, self._ids(others)))
        tokenize = self.tokenizer.model.tokenize
        new = [ids[t] if t in ids else [x.id for x in tokenize(spelled.get(t, t))] for t in texts]
        ends = np.cumsum([0, *map(len, new)])
        flat = np.fromiter(chain.from_iterable(new), self.dtype, ends[-1])
        coded = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends * flat.itemsize), pa.py_buffer(flat)])
        self.known.update(zip(parts, range(len(self.ids), len(self.ids) + len(new))))
        self.ids = pa.concat_arrays([self.ids, coded])
        self.size += len(parts) * ENTRY + 3 * sum(map(len, parts))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in a row, and how many lie before each text and after the last."""
        lines = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()), null_handling="replace")
        begins = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1]
        data = np.frombuffer(lines.buffers()[2], np.uint8)[: begins[-1]]
        kinds = KINDS[data]
        odd = [np.flatnonzero(kinds == OTHER)]
        for lead, after in NO_LETTERS:
            at = np.flatnonzero(data == lead)
            odd.append(at[np.isin(data[at + 1], after)])
        if any(pc.any(pc.match_substring(lines, a)).as_py() for a in self.added):
            odd.append(np.array([m.start() for m in self.marked.finditer(data.tobytes())], np.int64))
        odd, given = np.concatenate(odd), data
        data = LOWER[data] if self.lowered else data
        if len(odd):
            spaces = np.flatnonzero(kinds == SPACE)
            word = np.unique(np.searchsorted(spaces, odd))
            first = np.concatenate([[0], spaces[:-1] + 1])[word]
            size = spaces[word] - first
            inside = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            kinds[inside] = OTHER
            if self.lowered:
                data[inside] = given[inside]
        solid = kinds != SPACE
        starts = solid.copy()
        starts[1:] &= kinds[1:] != kinds[:-1]
        before = np.searchsorted(np.flatnonzero(starts), begins)
        data, starts = data[solid], starts[solid]
        places = np.append(np.flatnonzero(starts), len(data))
        return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]), before

    def _by_parts(self, texts: pa.Array) -> list[bytes]:
        if self.size > REMEMBERED:
            self._forget()
        parts, before = self._cut(texts)
        if not len(parts):
            return [b""] * len(texts)
        coded = parts.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        # a part is looked up once; its ids are then copied to all its places
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self._learn([keys[i] for i in new.tolist()])
        _, ends, raw = self.ids.take(pa.array(place).take(coded.indices)).buffers()
        bounds, raw = np.frombuffer(ends, np.int64)[before].tolist(), memoryview(raw)
        return [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_word:
            return [np.array(ids, self.dtype).tobytes() + self.end for ids in self._ids([t or "" for t in texts.to_pylist()])]
        if len(texts) == 1 and len(text := texts[0].as_py() or "") > TOGETHER:
            return [b"".join([*(self._by_parts(pa.array([some], pa.large_string()))[0] for some in _stretches(text)), self.end])]
        return [ids + self.end for ids in self._by_parts(texts)]


def _stretches(text: str) -> Iterator[str]:
    """A long text in stretches of whole words."""
    first = 0
    while first < len(text):
        gap = GAP.search(text, first + TOGETHER)
        stop = gap.end() if gap else len(text)
        yield text[first:stop]
        first = stop


_encoders: dict[tuple, Encoder] = {}


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def file_bytes(ids: bytes, dtype: str, ends: list[int], doc_ids: list[int | None]) -> list[bytes]:
    """The pieces of a file. doc_ids ascend, nulls first; they are counted in the header."""
    nulls = sum(d is None for d in doc_ids)
    docs = encode(np.array(doc_ids[nulls:], np.int64))
    bounds = encode(np.array(ends, np.int64))
    head = json.dumps({"dtype": dtype, "ids": len(ids), "ends": len(bounds), "docs": len(docs), "null_docs": nulls}).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, ids, bounds, docs]


class TokenFile:
    """A file opened for reading; ids are read by ranges."""

    def __init__(self, path: str):
        system, place = _open_folder(path)
        self._file = system.open_input_file(place)
        head = self._file.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int.from_bytes(head[8:], "little")
        info = json.loads(self._file.read_at(size, 12))
        self.dtype, self._ids = np.dtype(info["dtype"]), 12 + size
        self.ends = EliasFano(self._file.read_at(info["ends"], self._ids + info["ids"]))
        self._docs = EliasFano(self._file.read_at(info["docs"], self._ids + info["ids"] + info["ends"]))
        self._nulls = info["null_docs"]

    def __len__(self) -> int:
        return len(self.ends)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        known = self._docs.select(max(0, first - self._nulls), max(0, stop - self._nulls))
        return [None] * (min(stop, self._nulls) - min(first, self._nulls)) + known.tolist()

    def bounds(self, first: int, stop: int) -> np.ndarray:
        """Where documents first to stop - 1 begin, and where the last of them ends."""
        ends = self.ends.select(max(0, first - 1), stop)
        return ends if first else np.concatenate([[0], ends])

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self._file.read_at((stop - start) * width, self._ids + start * width), self.dtype)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document of that id, found by binary search."""
        i = self._docs.find(doc_id)
        if i == len(self._docs) or self._docs[i] != doc_id:
            return None
        at, to = self.bounds(self._nulls + i, self._nulls + i + 1)
        return self.ids(int(at), int(to))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of `docs` (doc_id integer, text) into files in `folder` and returns the manifest, kept there as a table.

    Files are in ascending order of doc_id, nulls first; rows of one id are ordered by a hash of the text, equal rows in
    any order. Null texts are empty and have the end id alone. An empty table gives an empty manifest; further columns
    are ignored. The folder must be one that all executors reach by a file system of pyarrow.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        settings = f.read()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # not the text: Spark samples the order's columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (hash(settings), end_id)
        if key not in _encoders:
            _encoders[key] = Encoder(settings, end_id)
        encoder, part, number = _encoders[key], TaskContext.get().partitionId(), 0
        width = np.dtype(encoder.dtype).itemsize
        system, place = _open_folder(folder)
        ids, ends, doc_ids, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{place}/{name}") as out:
                for piece in file_bytes(b"".join(ids), encoder.dtype, ends, doc_ids):
                    out.write(piece)
            known = [d for d in doc_ids if d is not None]
            row = {"part": part, "file_no": number, "path": f"{folder}/{name}", "n_docs": len(ends), "n_ids": total, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None}
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in MANIFEST.split(", "))]))

        def coded_rows() -> Iterator[tuple[int | None, bytes]]:
            """The rows' ids, some texts at a time."""
            for batch in batches:
                texts, names, first = batch.column("text"), batch.column("doc_id").to_pylist(), 0
                upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
                while first < len(names):
                    most = TOGETHER + (upto[first - 1] if first else 0)
                    stop = max(first + 1, int(np.searchsorted(upto, most, "right")))
                    yield from zip(names[first:stop], encoder.encode(texts.slice(first, stop - first)))
                    first = stop

        for doc_id, coded in coded_rows():
            if ends and total + len(coded) // width > file_ids:
                yield flush()
                ids, ends, doc_ids, total, number = [], [], [], 0, number + 1
            ids.append(coded)
            total += len(coded) // width
            ends.append(total)
            doc_ids.append(doc_id)
        if ends:
            yield flush()

    system, place = _open_folder(folder)
    system.create_dir(place, recursive=True)
    rows.mapInArrow(save, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, one row each, with `start`: the ids in files before. One row per file passes one window."""
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned 32-bit numbers), from the files of a manifest."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with TokenFile(row["path"]) as f:
                    first = 0
                    while first < len(f):
                        stop = min(first + READ_DOCS, len(f))
                        bounds = f.bounds(first, stop)
                        stop = first + max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
                        stop = min(stop, first + len(bounds) - 1)
                        bounds = bounds[: stop - first + 1]
                        raw = f.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                        places = (bounds - bounds[0]) * 4
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(f.doc_ids(first, stop), pa.int64()), pa.array(bounds[:-1] + row["start"], pa.int64()),
                                pa.array(np.diff(bounds), pa.int64()), pa.array([raw[a:b] for a, b in zip(places, places[1:])], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        first = stop

    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = files.select("path", "start").repartition(parts, "path")
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
