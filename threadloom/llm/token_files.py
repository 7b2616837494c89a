"""Token ids as Arrow files of equal-length sequences.

Documents are put in order of their id over range partitions; each partition's task encodes its whole texts with a tokenizer's
file, appends the end id to each, and writes one stream of ids as an Arrow file: batches with the columns ``ids`` and ``mask``,
fixed-size lists of ``length`` each, in which only the file's last sequence has padding (mask false). Buffers are not
compressed, so a memory map of the file gives any sequence without a copy: batch ``k // rows`` holds sequence ``k``. Beside
it lies a small Arrow file of the documents (doc_id, start in the file's stream, n_tokens).

A task that is tried again, or twice at once, writes files of another name; the manifest, a table written once all tasks have
ended, names the files that count, and readers open no others. Offsets over all files come from the manifest.

A text's ids are the ids of its words one after the other where the tokenizer's rules say so (``Coder``), so each worker
encodes a word once and keeps it; other tokenizers and texts get whole texts encoded. Both ways use the library's encoder.

Edge cases: null text is empty and has the end id alone. Null ids come first. Rows that repeat an id, and rows alike, are
documents each, next to each other, in order of their text's hash. A very long text is held by its task alone with its ids.
Strings of the tokenizer's special tokens in a text become these tokens, as the library does. An empty table gives an empty manifest
and no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MANIFEST = "part int, file string, docs_file string, docs long, tokens long, sequences long"
#: Rules under which words can be encoded one by one: they never reach over white space, and what they do to characters up
#: to U+00FF is to lower them. The pattern and steps of the tokenizer's file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The same pattern over lowered characters up to U+00FF; its branches begin with different characters, so letters may go first.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
WORD = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
OTHER = re.compile("[^\x00-\xff]")
BLANKS = re.compile(r"[\t-\r ]+")


class Coder:
    """Texts to ids, as bytes of ``dtype``. ``words`` bounds how many words are kept."""

    def __init__(self, rules: str, words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.kept = Tokenizer.from_str(rules), words, {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        said = json.loads(rules)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        before, suffix = said.get("pre_tokenizer") or {}, said["model"].get("end_of_word_suffix")
        split = [p.get("pattern", {}).get("Regex") for p in before.get("pretokenizers", [])]
        self.by_word = bool(suffix) and (said.get("normalizer") or {}).get("normalizers") == STEPS and split == [WORD_PATTERN, None] and not said.get("truncation") and not said.get("post_processor")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.closes[i] = bool(suffix) and piece.endswith(suffix)

    def whole(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.dtype).tobytes() for e in encode(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str]:
        """The words of a text; a stretch without blanks that has characters beyond U+00FF is one."""
        if not OTHER.search(text):
            return WORD.findall(text.lower())
        each = ([c] if OTHER.search(c) else WORD.findall(c.lower()) for c in BLANKS.split(text))
        return list(chain.from_iterable(each))

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if not OTHER.search(w)]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            self.kept.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))) if len(ends) == len(some) else zip(some, self.whole(some)))
        other = [w for w in words if OTHER.search(w)]
        if other:
            self.kept.update(zip(other, self.whole(other)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        each = [[] if i in odd else self.words(t) for i, t in enumerate(texts)]
        used = set(chain.from_iterable(each))
        if len(self.kept) + len(used) > self.most:
            self.kept.clear()
        self.learn(list(used.difference(self.kept)))
        out = [b"".join(map(self.kept.__getitem__, words)) for words in each]
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return out


_CODERS: dict[int, Coder] = {}


def coder(rules: str) -> Coder:
    """One a worker: the words it keeps serve its later tasks."""
    key = hash(rules)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(rules)
    return _CODERS[key]


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


def write(docs: DataFrame, folder: str, tokenizer_file: str, length: int = 2048, rows: int = 64, end_id: int = 1, part_bytes: int = 32 << 20) -> DataFrame:
    """Encode (doc_id, text) into ``folder``, which all executors share, and return the manifest (also at ``folder/_manifest``):
    a row a file. ``rows`` sequences make a batch; ``part_bytes`` is about what a file has of text."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        rules = f.read()
    id_type = docs.schema["doc_id"].dataType
    volume = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    parts = max(1, -(-volume // part_bytes))
    # Rows alike have keys of their own, so that no partition gathers them.
    keyed = docs.select("doc_id", "text", common.text_key(F.col("text")).alias("tk"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "tk", "row"]
    placed = keyed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        code = coder(rules)
        fs, at = filesystem(folder)
        fs.create_dir(at)
        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}"
        schema, step = sequence_schema(code.dtype, length), rows * length
        pending, held, tokens, ids, starts, counts, sink = [], 0, 0, [], [], [], None
        end = np.array([end_id], code.dtype).tobytes()

        def put(flat: np.ndarray, real: int):
            mask = np.arange(len(flat)) < real
            sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in ((flat, schema.field(0)), (mask, schema.field(1)))], schema=schema))

        for batch in batches:
            for own, texts in common.texts_of(batch):
                if sink is None:
                    out = fs.open_output_stream(f"{at}/{name}.arrow")
                    sink = pa.ipc.new_file(out, schema)
                ids.append(own.column(0))
                for raw in code.encode(texts):
                    n = len(raw) // code.dtype.itemsize + 1
                    pending += [raw, end]
                    starts.append(tokens)
                    counts.append(n)
                    tokens, held = tokens + n, held + n
                    if held >= step:
                        flat = np.frombuffer(b"".join(pending), code.dtype)
                        full = held // step * step
                        for i in range(0, full, step):
                            put(flat[i : i + step], step)
                        pending, held = [flat[full:].tobytes()], held - full
        if sink is None:
            return
        if held:
            flat = np.zeros(-(-held // length) * length, code.dtype)
            flat[:held] = np.frombuffer(b"".join(pending), code.dtype)
            put(flat, held)
        sink.close()
        out.close()
        table = pa.table({"doc_id": pa.chunked_array(ids), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{at}/{name}.docs.arrow") as docs_out, pa.ipc.new_file(docs_out, table.schema) as w:
            w.write_table(table, max_chunksize=1 << 16)
        row = {"part": [part], "file": [f"{name}.arrow"], "docs_file": [f"{name}.docs.arrow"], "docs": [len(starts)], "tokens": [tokens], "sequences": [-(-tokens // length)]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs_file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("sequences", pa.int64())]))

    placed.mapInArrow(encode, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    found.id_type = id_type
    return found


def open_file(folder: str, name: str) -> tuple[pa.ipc.RecordBatchFileReader, object]:
    """A reader of an Arrow file and its source: a memory map where the folder is a local or mounted one."""
    fs, at = filesystem(folder)
    source = pa.memory_map(f"{at}/{name}") if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(f"{at}/{name}")
    return pa.ipc.open_file(source), source


class Sequences:
    """Random access to one file's sequences; with a memory map, ids and masks are views of it."""

    def __init__(self, folder: str, name: str):
        self.reader, self.source = open_file(folder, name)
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.batch = i, self.reader.get_batch(i)
        return self.batch

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        b, i = self._batch(k // self.rows), k % self.rows
        part = slice(i * self.length, (i + 1) * self.length)
        return b.column(0).values.to_numpy(zero_copy_only=True)[part], b.column(1).values[part]

    def stream(self, start: int, n: int):
        """The stream's ids from ``start`` on, ``n`` of them, in views of a batch each."""
        step = self.rows * self.length
        while n > 0:
            i, a = divmod(start, step)
            flat = self._batch(i).column(0).values.to_numpy(zero_copy_only=True)[a : a + n]
            yield flat
            start, n = start + len(flat), n - len(flat)


def documents(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over ids as little-endian 32-bit), read from the files."""
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    before = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    parts = max(1, found.count())
    files = found.select("part", "file", "docs_file", before).withColumn("task", F.row_number().over(W.orderBy("part")) - 1).repartitionById(parts, F.col("task").cast("int"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sequences = Sequences(folder, row["file"])
                reader, source = open_file(folder, row["docs_file"])
                for i in range(reader.num_record_batches):
                    b = reader.get_batch(i)
                    start, n = (b.column(c).to_numpy() for c in (1, 2))
                    crc = np.zeros(len(b), np.int64)
                    for j, (s, m) in enumerate(zip(start.tolist(), n.tolist())):
                        c = 0
                        for view in sequences.stream(s, m):
                            c = zlib.crc32(view.astype("<u4").tobytes(), c)
                        crc[j] = c
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start + row["before"]), b.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                source.close()
                sequences.source.close()

    return files.drop("task").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
