"""Ranked search, the source audit and token files, each against a plain version on hard cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import lexical_search, source_divergence, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string"
EXTRA = ("shard", "rank", "score", "q", "n", "terms", "row", "tk", "value", "part", "start", "ids", "item_id", "term", "block")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=150):
    """Two vocabularies, copies, ties, nulls, empty and very long texts, repeated rows and ids."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        pool = [f"{'ab'[i % 2]}{j}" for j in range(40)] + ["Über", "THE", "x-y", "42"]
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))), ("en", None, "")[i % 3], ("s1", "s2", None, "s3")[i % 4]))
    rows += [(1000 + i, "a1 a2 the tie", "en", "s1") for i in range(30)] + [(2000, None, "en", "s2"), (2001, "", None, None), (2002, "a3 " * 50_000, "en", "s9"), (2003, "?! ", "xx", "s1"), (2003, "?! ", "xx", "s2")]
    return rows + [rows[5]] * 3 + [(None, "a1 a2 the tie", None, "s1")] * 2 + [(5, "a9 a9 b2", "en", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(corpus(), DOCS)
    return d.withColumns({c: F.lit(None).cast("string") for c in EXTRA if c not in d.columns}).repartition(3).cache()


def plain_search(rows, items, top):
    bags = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)))) for d, t, *_ in rows]
    held = Counter(t for _, b in bags for t in b)
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        asked = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in asked.items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"block": 3, "first_wave": 1, "growth": 2, "few": 0}, {"most_terms": 2}])
def test_search(spark, docs, options):
    """Small shards and blocks, many waves: the same rows as scoring every document."""
    items = [(1, "a1 A1 the"), (2, "b3 über 42"), (3, None), (4, ""), (5, "nothing here"), (None, "a3"), (1, "a1 A1 the"), (7, " ".join(f"a{j} b{j}" for j in range(40)))]
    index = lexical_search.build(docs, lexical_search.fit(docs, depth=3), shard_bytes=900, part_bytes=4000)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("q", F.lit("x"))
    got = sorted((tuple(r) for r in lexical_search.search(index, queries, "item_id", top=5, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_search(corpus(), items, 5) and index.shards.count() > 10
    assert index.docs.count() == len(corpus())


def test_search_nothing(spark, docs):
    index = lexical_search.build(docs.limit(0))
    items = spark.createDataFrame([(1, "a1")], "item_id long, text string")
    assert lexical_search.search(index, items, "item_id").count() == 0
    index = lexical_search.build(docs)
    assert lexical_search.search(index, items.limit(0), "item_id").count() == 0 and lexical_search.search(index, items, "item_id").count() == 10


def test_bisection_separates():
    """Documents of two vocabularies go to different halves, those of the sample and others alike; the halves are even."""
    rng = random.Random(2)
    text = lambda i: " ".join(f"{'ab'[i % 2]}{rng.randrange(50)}" for _ in range(30))
    tree = lexical_search.Tree([text(i) for i in range(200)], 2)
    for fresh in (False, True):
        bags = [sorted(set(lexical_search.tokens(text(i) + (" unseen words" if fresh else "")))) for i in range(200)]
        flat = np.array([tree.terms.get(t, len(tree.terms)) for b in bags for t in b])
        leaf, _ = tree.place(flat, np.array([len(b) for b in bags]))
        assert {x // 2 for x in leaf[::2]}.isdisjoint({x // 2 for x in leaf[1::2]}) and min(Counter(leaf.tolist()).values()) > 20


def plain_audit(rows, least, top):
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        n[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for t, k in held[lang].items() if k >= least]
        own = sorted(s for x, s in groups if x == lang)
        count = {s: {t: n[lang, s][t] for t in terms} for s in own}
        whole = {t: sum(count[s][t] for s in own) for t in terms}
        share = lambda c: {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(terms)) for t, k in c.items()}
        p, q = {s: share(count[s]) for s in own}, share(whole)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in own if o != s)
            used = sorted((q[t] - p[s][t], t.encode(), t) for t in terms if count[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(used[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 2, "part": 3, "few": 0}])
def test_audit(docs, options):
    """Small cells; a language without kept words, sources without words, terms with equal vectors."""
    got = sorted(tuple(r) for r in source_divergence.audit(docs, least=8, top=4, **options).select("lang", "source", "part", "item", "value", "rank").collect())
    want = plain_audit(corpus(), 8, 4)
    assert got == want and any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in want) and len({r[2] for r in got}) == 2
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_audit_counts_in_stretches(docs):
    few = source_divergence.counted(docs, flush=5).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, source_divergence.counted(docs).collect()))


def hard_texts():
    rng = random.Random(1)
    pool = [chr(i) for i in range(256)] + list("'sStTrevVmLlDd  \t\n") * 6 + list("éÉßñÑ²½ ́İΣς😀中文́　") + ["<|endoftext|>", "<|startoftext|>", "hello", "World's"]
    return [chr(i) for i in range(0x300)] + ["a" + chr(i) + "b " + chr(i) + "'S" + chr(i) for i in range(0x300)] + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(5000)]


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_words_make_the_text(name, by_word):
    """Ids word by word are those that the library gives for whole texts, also when the kept words are dropped again and again."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        rules = f.read()
    texts = hard_texts()
    code = token_files.Coder(rules)
    want = code.whole(texts)
    assert code.by_word == by_word and code.encode(texts) == want
    small = token_files.Coder(rules, words=50)
    assert [x for i in range(0, 3000, 100) for x in small.encode(texts[i : i + 100])] == want[:3000]


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    found = token_files.write(docs, folder, WORDS, length=16, rows=3, part_bytes=3000)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.documents(spark, folder).orderBy("start").collect()
    assert found.count() > 3 and [r.doc_id for r in got] == [r[0] for r in rows]
    with open(WORDS, encoding="utf-8") as f:
        code = token_files.Coder(f.read())
    ids = lambda t: np.frombuffer(code.whole([t or ""])[0], code.dtype).tolist() + [1]
    expected = Counter((r[0], zlib.crc32(np.array(ids(r[1]), "<u4").tobytes()), len(ids(r[1]))) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # Every file: equal lengths, padding in the last sequence only, and sequences that are views of the memory map.
    for r in found.collect():
        s = token_files.Sequences(folder, r.file)
        flat, masks = zip(*(s[k] for k in range(r.sequences)))
        assert {len(x) for x in flat} == {16} and sum(m.true_count for m in masks) == r.tokens and all(m.true_count == 16 for m in masks[:-1])
        before = pa.total_allocated_bytes()
        ids_, mask = s[r.sequences - 1]
        assert not ids_.flags.owndata and not ids_.flags.writeable and pa.total_allocated_bytes() == before


def test_token_files_of_failed_attempts(spark, docs, tmp_path):
    """Files that the manifest does not name are not read."""
    folder = f"{tmp_path}/tokens"
    token_files.write(docs, folder, WORDS, length=16, rows=3)
    want = sorted(map(str, token_files.documents(spark, folder).collect()))
    (tmp_path / "tokens/part-0000000-other.arrow").write_bytes(b"half a file")
    assert sorted(map(str, token_files.documents(spark, folder).collect())) == want
    token_files.write(docs.limit(0), f"{tmp_path}/none", WORDS)
    assert token_files.documents(spark, f"{tmp_path}/none").count() == 0
