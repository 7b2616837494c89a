"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of variable order (0 to ``max_order``) is counted on a bounded sample, then
frozen. A symbol's probability in its longest context is count / (n + d), for n symbols seen there and d different ones;
else the escape d / (n + d) times the next shorter context's probability, with the symbols of the longer one excluded.
With frozen statistics a byte's code length is a function of its context: the trees of all languages are kept as one
table of contexts (bits of the escape, exclusion included) and one of contexts and symbols (bits of a seen symbol), both
found by hash, so a text's exact code length under each language is a sum of look-ups, order by order.

Edge cases: null and empty texts and those without a letter get ``und`` and score 0. Null doc_ids are scored and never
learned from. With no labelled text at all every document is ``und``. Languages whose lengths tie go to the first by name.
Very long texts are coded whole, in pieces of bounded size. Repeated rows are scored each. An empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


START = b"\n"


class Lookup:
    """The place of a 64-bit key among those given, or -1: open addressing in a table of at least four times their number."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(np.ceil(np.log2(4 * max(len(keys), 1)))))
        self.table, self.probes = np.full(1 << self.bits, -1, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.table[slot] < 0
            # Of several that want a slot the last written has it.
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for probe in range(self.probes):
            place = self.table[self._slot(keys[at], probe)]
            hit = (place >= 0) & (self.keys[np.maximum(place, 0)] == keys[at])
            out[at[hit]] = place[hit]
            at = at[(place >= 0) & ~hit]
            if not len(at):
                break
        return out


class ContextTrees:
    """Code lengths in bits of texts under each language. ``escape[order][context, language]`` and
    ``lengths[order][context and symbol, language]`` are found by ``contexts[order]`` and ``pairs[order]``; a language that has
    not seen a pair that another has gets its escapes and the shorter context's length there. ``base[symbol, language]`` is
    order 0. A byte is looked up in its longest context first, so nearly all take one look."""

    def __init__(self, samples: dict[str, list[str]], max_order: int = 4):
        if not 1 <= max_order <= 6:
            raise ValueError("a context and its symbol must fit in 64 bits: max_order is 1 to 6")
        self.langs, self.order = sorted(samples), max_order
        data = {k: np.frombuffer((START * max_order).join([b"", *(self._raw(t) for t in samples[k])]), np.uint8) for k in self.langs}
        trees = [self._counted(data[k]) for k in self.langs]
        self.base = np.full((256, len(self.langs)), 8.0, np.float32)
        for j, tree in enumerate(trees):
            keys, n = tree[0]
            total, kinds = n.sum(), len(keys)
            if kinds < 256:
                self.base[:, j] = -np.log2(kinds / (total + kinds) / (256 - kinds))
            self.base[keys.astype(np.int64), j] = -np.log2(n / (total + kinds * (kinds < 256)))
        self.contexts, self.escape, self.pairs, self.lengths = [None], [None], [None], [None]
        for order in range(1, max_order + 1):
            pairs = np.unique(np.concatenate([t[order][0] for t in trees]))
            contexts = np.unique(pairs >> np.uint64(8))
            escape, seen = np.full((len(contexts), len(trees)), 0, np.float32), np.full((len(pairs), len(trees)), np.nan, np.float32)
            for j, tree in enumerate(trees):
                keys, n = tree[order]
                if not len(keys):
                    continue
                own = keys >> np.uint64(8)
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total, kinds = np.add.reduceat(n, starts), np.diff(np.r_[starts, len(own)])
                # What the shorter context leaves to symbols not seen in this one.
                lower = self._bits_of(keys, order - 1)[:, j].astype(np.float64)
                rest = 1 - np.add.reduceat(np.exp2(-lower), starts)
                open_ = (kinds < 256) & (rest > 1e-12)
                at = np.searchsorted(contexts, own[starts])
                escape[at, j] = np.where(open_, -np.log2(np.where(open_, kinds / (total + kinds) / np.maximum(rest, 1e-12), 1)), 0)
                spread = np.repeat(total + kinds * open_, kinds)
                seen[np.searchsorted(pairs, keys), j] = -np.log2(n / spread)
            shorter = self._bits_of(pairs, order - 1) + escape[np.searchsorted(contexts, pairs >> np.uint64(8))]
            self.contexts.append(Lookup(contexts))
            self.escape.append(escape)
            self.pairs.append(Lookup(pairs))
            self.lengths.append(np.where(np.isnan(seen), shorter, seen))

    @staticmethod
    def _raw(text: str) -> bytes:
        return text.encode("utf-8", "replace").translate(LOWER)

    def _counted(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the contexts with their symbols (8 bits a byte, the symbol lowest) and their counts."""
        out = []
        for order in range(self.order + 1):
            keys = self._keys(s, order)[self.order :]
            out.append(tuple(np.unique(keys, return_counts=True)))
        return out

    @staticmethod
    def _keys(s: np.ndarray, order: int) -> np.ndarray:
        """The last ``order`` bytes and the byte itself, at each position."""
        out = s.astype(np.uint64)
        for back in range(1, order + 1):
            out[back:] |= s[:-back].astype(np.uint64) << np.uint64(8 * back)
        return out

    def _bits_of(self, keys: np.ndarray, order: int) -> np.ndarray:
        """(key, language): code lengths of symbols after contexts of ``order`` bytes at most (the key's lowest)."""
        bits, left = np.zeros((len(keys), len(self.langs)), np.float32), np.arange(len(keys))
        for o in range(order, 0, -1):
            part = keys[left] & np.uint64((1 << (8 * (o + 1))) - 1)
            pair = self.pairs[o](part)
            found = pair >= 0
            bits[left[found]] += self.lengths[o][pair[found]]
            left, part = left[~found], part[~found]
            if not len(left):
                return bits
            context = self.contexts[o](part >> np.uint64(8))
            known = context >= 0
            bits[left[known]] += self.escape[o][context[known]]
        bits[left] += self.base[(keys[left] & np.uint64(255)).astype(np.int64)]
        return bits

    def bits(self, texts: list[str], piece: int = 1 << 16) -> np.ndarray:
        """Code length of each text under each language; each text is coded on its own, after a line's start."""
        out = np.zeros((len(texts), len(self.langs)))
        raw = [START * self.order + self._raw(t) for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        s = np.frombuffer(b"".join(raw), np.uint8)
        keys, owner = self._keys(s, self.order), np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        inside = np.ones(len(s), bool)
        for i in range(self.order):
            inside[np.concatenate([[0], ends[:-1]]) + i] = False
        keys, owner = keys[inside], owner[inside]
        for a in range(0, len(keys), piece):
            each, own = self._bits_of(keys[a : a + piece], self.order), owner[a : a + piece]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[starts]] += np.add.reduceat(each, starts, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, per_language: int, max_order: int, most_bytes: int, languages: int, seed: int = 29) -> ContextTrees | None:
    """At most ``per_language`` documents of each language, whole texts of ``most_bytes`` together at most, first by a seeded
    hash, over all that may be learned from; of more than ``languages`` languages those with most documents."""
    keys = docs.select("doc_id", F.col("lang").alias("part")).where(F.col("lang").isNotNull() & (common.fold_of(F.col("doc_id"), 4) != 2))
    keys = keys.groupBy("doc_id", "part").agg(F.lit(1).alias("y"))
    most = keys.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(languages).select("part")
    source = docs.select("doc_id", F.col("lang").alias("part"), "text").where(F.col("text").isNotNull())
    rows = common.sampled_rows(source, keys.join(F.broadcast(most), "part", "left_semi"), per_language, most_bytes, ("doc_id", "part"), seed).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.part, str(r.doc_id), r.text)):
        samples.setdefault(r.part, []).append(r.text)
    return ContextTrees(samples, max_order) if samples else None


def identify(docs: DataFrame, per_language: int = 300, max_order: int = 4, most_bytes: int = 2 << 20, languages: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model sees the text alone. The middle three bound the sample."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, per_language, max_order, most_bytes, languages))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def scored(batches):
        trees = model.value
        for batch in batches:
            for rows, texts in common.texts_of(batch, limit=1 << 19):
                named = np.array([trees is not None and any(map(str.isalpha, t)) for t in texts])
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if named.any():
                    bits = trees.bits([t for t, n in zip(texts, named) if n])
                    odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -60))
                    lang[named] = np.array(trees.langs, object)[bits.argmin(axis=1)]
                    score[named] = 1 / odds.sum(axis=1)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(common.fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(scored, schema)
