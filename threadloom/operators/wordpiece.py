"""Word pieces: vocabulary, encoding, and chunks of so many tokens. Arrow batches; the vocabulary is broadcast."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_parts

#: Least lengths, and the tokens that mark a chunk's beginning and end.
LEAST, CHUNK_LEAST, MARKS = 8, 16, 2
KINDS = (("text", "text"), ("code", "aggregate_code"), ("execution_output", "execution_output"))


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to line number, from 0; blank lines keep their numbers, and a token that comes twice raises. One token a line: a
    vocabulary is as large as its tokenizer and fits in the driver."""
    lines = spark.read.text(path, wholetext=True).first()[0].replace("\r\n", "\n").split("\n")
    out: dict[str, int] = {}
    for i, line in enumerate(lines):
        token = line.strip()
        if token and token in out:
            raise ValueError(f"token twice in the vocabulary: {token}")
        if token:
            out[token] = i
    return out


def is_lfs_pointer(spark: SparkSession, path: str) -> bool:
    """Whether a file is a stand-in of large file storage instead of a model: two known lines at its head."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 200).cast("string")).first()
    lines = (head[0] if head else "").splitlines()
    return len(lines) > 1 and lines[0].startswith("version https://git-lfs.github.com/spec/") and lines[1].startswith("oid sha256:")


class WordPieces:
    def __init__(self, tokens: dict[str, int], normalize: bool = True):
        """``normalize``: compatibility forms and small letters, as the plain tokenizer does; without it texts stay as they are."""
        self.tokens, self.normalize = tokens, normalize
        self.longest = max(map(len, tokens), default=0)
        find = lambda name: tokens.get(f"[{name}]", tokens.get(f"[{name.lower()}]", 0))
        self.pad, self.unknown = find("PAD"), find("UNK")

    def words(self, text: str) -> list[tuple[str, int, int]]:
        """(word, start, end): runs of letters and digits, and every other character but white space on its own. Positions are in
        the text as it is; a character that normalises to several stands for all of them."""
        out: list[tuple[str, int, int]] = []
        run, begin = "", 0
        for i, raw in enumerate(text):
            for c in unicodedata.normalize("NFKC", raw).lower() if self.normalize else raw:
                kind = unicodedata.category(c)
                if kind[0] == "L" or kind == "Nd":
                    begin = begin if run else i
                    run += c
                    continue
                if run:
                    out.append((run, begin, i))
                    run = ""
                if not c.isspace():
                    out.append((c, i, i + 1))
        if run:
            out.append((run, begin, len(text)))
        return out

    def pieces(self, word: str) -> list[str]:
        """The longest pieces from left to right; where none fits, [UNK] after those found so far."""
        if word in self.tokens:
            return [word]
        out, start = [], 0
        while start < len(word):
            mark = "##" if start else ""
            for end in range(min(len(word), start + self.longest), start, -1):
                if mark + word[start:end] in self.tokens:
                    break
            else:
                return [*out, "[UNK]"]
            out.append(mark + word[start:end])
            start = end
        return out

    def encode(self, text: str, most: int) -> tuple[list[int], list[int], list[int], int]:
        """Ids between [CLS] and [SEP], padded to ``most`` (8 at least); mask; type ids; tokens."""
        length, out = max(LEAST, most), ["[CLS]"]
        for word, _, _ in self.words(text):
            out += self.pieces(word)
            if len(out) >= length - 1:
                break
        out = [*out[: length - 1], "[SEP]"]
        n = len(out)
        return [self.tokens.get(t, self.unknown) for t in out] + [self.pad] * (length - n), [1] * n + [0] * (length - n), [0] * length, n

    def spans(self, word: str, start: int) -> list[tuple[int, int]]:
        """(start, end) of the word's pieces in the text, where the word begins at ``start``; a word that can't be cut is one unknown piece."""
        found = self.pieces(word)
        if found[-1] == "[UNK]":
            return [(start, start + len(word))]
        lengths = [len(p) - 2 * (i > 0) for i, p in enumerate(found)]
        ends = [start + n for n in accumulate(lengths)]
        return list(zip([start, *ends], ends))

    def chunks(self, text: str, most: int, overlap: int) -> list[tuple[str, int]]:
        """(chunk, tokens) of at most ``most`` tokens (16 at least) with the two that mark the ends, trimmed. A chunk ends behind its last piece,
        also inside a word, whose rest is then a word of its own; the next one begins where the last ``overlap`` pieces do, counted from
        the trimmed chunk's beginning, or behind it where there are no more. Words are cut once, but for those rests, so the work
        grows with the text and the overlap."""
        most = max(CHUNK_LEAST, most)
        overlap, room = min(max(overlap, 0), most - 1), most - MARKS
        text = text.replace("\r\n", "\n")
        words = [(start, start + len(word), word) for word, start, _ in self.words(text)]
        if not words:
            return [(text, MARKS)] if text.strip() else []
        cut = [self.spans(word, start) for start, _, word in words]
        ends, out, cursor = [end for _, end, _ in words], [], 0
        while cursor < len(text):
            k = bisect_right(ends, cursor)
            if k == len(words):
                break
            start, _, word = words[k]
            taken = cut[k] if start >= cursor else self.spans(word[cursor - start :], cursor)
            while len(taken) < room and k + 1 < len(words):
                k += 1
                taken = taken + cut[k]
            last = k == len(words) - 1 and len(taken) <= room
            taken = taken[:room]
            stop = len(text) if last else taken[-1][1]
            piece = text[cursor:stop]
            chunk = piece.strip()
            if chunk:
                out.append((chunk, len(taken) + MARKS))
            if last:
                break
            # Where the last pieces begin in the trimmed chunk; that many characters behind the cursor, as chunks are counted.
            back = taken[-overlap][0] - cursor - (len(piece) - len(piece.lstrip())) if 0 < overlap < len(taken) else 0
            cursor = cursor + back if 0 < back < len(chunk) else stop
        return out


def token_chunks(messages: DataFrame, tokens: dict[str, int], most: int = 256, overlap: int = 32) -> DataFrame:
    """conversation_id, node_id, kind, pos, chunk, tokens."""
    held = messages.sparkSession.sparkContext.broadcast(tokens)
    parts = [messages.select("conversation_id", "node_id", F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in KINDS]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.trim("value") != "")

    def cut(batches):
        pieces = WordPieces(held.value, normalize=False)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
        for part in small_parts(batches, 3):
            rows = [(*row[:3], i, chunk, n) for row in zip(*(c.to_pylist() for c in part.columns)) for i, (chunk, n) in enumerate(pieces.chunks(row[3], most, overlap))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conversation_id", "node_id", "kind", "pos", "chunk", "tokens"])

    return each.mapInArrow(cut, "conversation_id string, node_id string, kind string, pos int, chunk string, tokens int")


def found_vocabulary(texts: DataFrame, words: int = 2_000, characters: int = 2_000) -> dict[str, int]:
    """A vocabulary of the texts (text) themselves: the marks, the most frequent ``characters``, each also inside a word, and the most frequent
    ``words`` and halves of words. Counts are summed before they are shuffled, and the driver gets no more than asked for."""
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+|[^\s\p{L}\p{Nd}]"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    letters = runs.select(F.explode(F.split("w", "")).alias("x"), "n").where("x <> ''").groupBy("x").agg(F.sum("n").alias("n"))
    half = F.ceil(F.char_length("w") / 2).cast("int")
    parts = runs.where(F.char_length("w") > 3).select(F.explode(F.array(F.col("w"), F.left("w", half), F.concat(F.lit("##"), F.substring("w", half + 1, F.char_length("w"))))).alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n"))
    top = lambda df, k: [r.x for r in df.orderBy(F.col("n").desc(), "x").limit(k).collect()]
    single = top(letters, characters)
    every = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *single, *("##" + x for x in single), *top(parts, words)]
    return {t: i for i, t in enumerate(dict.fromkeys(every))}


def encoded(texts: DataFrame, tokens: dict[str, int], most: int = 256, normalize: bool = True) -> DataFrame:
    """id, input_ids, attention_mask, token_type_ids, n of (id, text)."""
    held = texts.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        pieces = WordPieces(held.value, normalize)
        for batch in batches:
            rows = [pieces.encode(t or "", most) for t in batch.column(1).to_pylist()]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([r[3] for r in rows], pa.int32())], names=["id", "input_ids", "attention_mask", "token_type_ids", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, input_ids array<long>, attention_mask array<long>, token_type_ids array<long>, n int")


def chunker(provider: str, tokens: dict[str, int] | None) -> str:
    """char or mltokenizer: by default the tokenizer if there is a vocabulary; asked for without one it raises."""
    if provider == "char" or (provider == "auto" and not tokens):
        return "char"
    if provider in ("auto", "mltokenizer") and tokens:
        return "mltokenizer"
    raise ValueError(f"chunking by {provider} needs a vocabulary" if provider == "mltokenizer" else f"unknown chunking provider {provider}")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """conversation_id, chunks, chunk_tokens (null where no chunk has a number of tokens)."""
    return chunks.groupBy("conversation_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("chunk_tokens"))
