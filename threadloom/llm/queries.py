"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, language_id, lexical_search, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, secrets, sharding, source_divergence, token_files


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, "contaminated")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(both).cast("long").alias("n_spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = secrets.written(F.array_sort(F.concat("base", "owned")))
    return found.select("doc_id", *map(count, secrets.PATTERNS), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(common.table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = common.durable(lexical_search.search(index, common.table(spark, sf_dir, "benchmark"), "item_id"))
    index.delete()
    return found


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(common.table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{common.shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    token_files.write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    read = common.durable(token_files.documents(spark, folder))
    common.delete(spark, folder)
    return read


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_mixing, op4_near_dedup, op5_line_dedup, op6_secrets, op7_sharding, op8_quality_rules, op9_quality_classifier, op10_language_id, op11_lexical_search, op12_source_divergence, op13_token_files, pipeline)}

LOWERED = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.UPPER.lower()}')"



def _secret_matches() -> str:
    """One row a match: where its pattern's matches so far, and what lies between them, add up to."""
    quoted = [p.replace("'", "''") for p in (secrets.PATTERNS["assign"], secrets.QUICK["access"], secrets.QUICK["hex"], secrets.WIDE)]
    return " UNION ALL ".join(f"SELECT doc_id, source, {r} AS rank, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t WHERE regexp_matches(x, '{p}')" for r, p in enumerate(quoted))


_VALUE = "regexp_extract(v, '{}', 2)".format(secrets.PATTERNS["assign"].replace("'", "''"))
_WRITTEN = "coalesce(string_agg(kind || ':' || (till - n) || ':' || till, ',' ORDER BY till - n, rank){}, '')"

SQL = {
    "op11_lexical_search": rf"""
        WITH t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents),
        g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(x))::BIGINT AS total FROM t WHERE len(x) > 0),
        p AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(x) AS term FROM t) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
        m AS (SELECT d, doc_id, 25 + (75 * len(x)::BIGINT * n_docs) // total AS m FROM t, g WHERE len(x) > 0),
        b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM benchmark),
        w AS (SELECT q, item_id, term, count(*) * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT q, item_id, unnest(x) AS term FROM b) JOIN f USING (term), g GROUP BY q, item_id, term, df, n_docs),
        s AS (SELECT q, item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM w JOIN p USING (term) JOIN m USING (d) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s JOIN m USING (d) WHERE score > 0 QUALIFY rank <= 10""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS tot FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        l AS (SELECT lang, count(*) AS v, sum(tot) AS lang_n FROM k GROUP BY ALL),
        f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.tot::HUGEINT AS tot FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        s AS (SELECT lang, source, sum(n) AS all_n FROM f GROUP BY ALL),
        p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 5)) // (all_n + 5 * v)::HUGEINT AS p, 1 + (1000000000 * (f.tot + 5)) // (lang_n + 5 * v)::HUGEINT AS q
            FROM f JOIN s USING (lang, source) JOIN l USING (lang)),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 50""",
    "op6_secrets": f"""
        WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
        f AS ({_secret_matches()}),
        each AS (SELECT doc_id, source, rank, i, m[i] AS v, length(m[i]) AS n, length(g[i]) AS gap FROM f, unnest(range(1, len(m) + 1)) AS u(i)),
        owners AS (
            SELECT CASE WHEN rank = 0 THEN {_VALUE} ELSE v END AS secret, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS repos, count(DISTINCT coalesce(source, '')) AS owners FROM each GROUP BY 1),
        placed AS (SELECT *, (sum(gap + n) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS till FROM each),
        good AS (
            SELECT *, ['assign', 'access', 'hex', 'owned'][rank + 1] AS kind FROM placed
            WHERE CASE rank WHEN 0 THEN length({_VALUE}) >= 6 WHEN 3 THEN regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') ELSE true END),
        kept AS (
            SELECT * FROM good g WHERE rank < 3 OR (
                NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = g.doc_id AND b.rank < 3 AND b.till - b.n < g.till AND g.till - g.n < b.till)
                AND v IN (SELECT secret FROM owners WHERE repos <= 20 AND owners <= 1))),
        found AS (
            SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
                {_WRITTEN.format(" FILTER (rank < 3)")} AS base, {_WRITTEN.format("")} AS spans FROM kept GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN found USING (doc_id)""",
    "op1_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
            FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
        spans AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM d, (SELECT DISTINCT n FROM wins) AS s, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
        met AS (SELECT doc_id, item_id, i, wins.n AS n FROM spans JOIN wins USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + n)) AS u(p) GROUP BY 1),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS o FROM documents),
        t AS (
            SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY source),
        r AS (
            SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
                coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS capped_w
            FROM t WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, (total - capped)::DOUBLE / (all_w - capped_w) AS lv FROM r),
        g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT max(lv) FROM l WHERE lv * weight <= 3.0::DOUBLE * source_size) * weight) AS target FROM l),
        m AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
            (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken FROM m""",
    "op5_line_dedup": rf"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
        l AS (SELECT doc_id, i, own[i] AS line, trim(translate(own[i], '{common.UPPER}', '{common.UPPER.lower()}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
            FROM d, unnest(range(1, len(own) + 1)) AS u(i)),
        s AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT l.*, s.k IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN s USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
}
