"""The command line: one index and its outputs, or a run of several profiles and their comparison."""

from __future__ import annotations

import json
import sys
from dataclasses import replace

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import categories as C
from ..operators import classifier, reports, similarity, store, wordpiece
from ..sources import files, sinks, tables
from . import index, language_model
from .config import PROFILES, USAGE, Config, parse, profile


def discovered(c: Config) -> Config:
    """Settings with the models that lie in ``models_dir``, where no other is named: the first ONNX file and ``vocab.txt`` by path, and the
    first folder with a saved classifier."""
    if not c.models_dir:
        return c
    fs, root = files.filesystem(c.models_dir)
    found = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file)
    first = lambda *ends: next((f"file://{x}" if isinstance(fs, pa.fs.LocalFileSystem) else x for x in found if x.endswith(ends)), "")
    saved = first("/model/metadata/part-00000").removesuffix("/model/metadata/part-00000")
    local = lambda path: path.removeprefix("file://")
    return replace(c, embedding_model=c.embedding_model or local(first(".onnx")), embedding_vocab=c.embedding_vocab or first("/vocab.txt"), mlnet_model=c.mlnet_model or saved)


def embedder(c: Config, vocabulary: dict[str, int], tokenizer: str) -> index.Embedder:
    """Vectors by the settings' model; the legacy tokenizer normalises texts, the library's takes them as they are."""
    pieces = wordpiece.WordPieces(vocabulary, tokenizer == "legacy")
    devices = similarity.devices(c.onnx_execution_provider, c.cuda_device_id, c.directml_device_id)
    encode = similarity.inputs_of(pieces, c.embedding_max_tokens)

    def vectors(corpora: DataFrame) -> DataFrame:
        found = store.kept(similarity.embed_onnx(corpora.select(F.col("conversation_id").alias("id"), F.col("corpus").alias("text")), c.embedding_model, encode, devices=devices))
        size = found.where("v is not null").agg(F.max(F.size("v"))).first()[0]
        failed = found.where("v is null").select(F.col("id").alias("conversation_id"))
        # Rows that the model fails on get hashed vectors of the same length.
        hashed = index.hash_vectors(corpora.join(failed, "conversation_id", "left_semi"), size or c.hash_embedding_dim)
        return found.where("v is not null").unionByName(hashed.where(F.size("v") == (size or c.hash_embedding_dim)))

    return vectors


def providers(spark: SparkSession, c: Config) -> index.Providers:
    """What the settings name and the files allow; what is missing falls back, with a note, unless it was asked for."""
    out, c = index.Providers(), discovered(c)
    if c.embedding_vocab:
        out.vocabulary = wordpiece.vocabulary(spark, c.embedding_vocab)
    if c.use_ollama:
        out.analyzer = language_model.analyzer(c, ledger=f"{c.output}/ledger")
    if c.labels_clusters():
        out.labeler = language_model.labeler(c, ledger=f"{c.output}/ledger")
    if c.category_provider != "heuristic" and c.mlnet_model:
        model = classifier.load(c.mlnet_model)
        out.predictor = lambda corpora: classifier.predict_top(model, corpora)
    elif c.category_provider == "mlnet":
        out.notes.append("no classifier: the baseline's categories count")
    if c.embedding_provider in ("auto", "onnx"):
        if c.embedding_model and out.vocabulary and not wordpiece.is_lfs_pointer(spark, c.embedding_model):
            out.embedder = embedder(c, out.vocabulary, c.onnx_tokenizer)
            if c.compare_onnx_tokenizers:
                out.tokenizers = (embedder(c, out.vocabulary, "legacy"), embedder(c, out.vocabulary, "mltokenizer"))
            out.description = f"onnx:{c.embedding_model.rsplit('/', 1)[-1]}"
        elif c.embedding_provider == "onnx":
            out.notes.append("no model or vocabulary: hashed vectors instead")
    return out


def run(spark: SparkSession, c: Config, messages: DataFrame | None = None, found: index.Providers | None = None) -> dict[str, DataFrame]:
    """Builds the index of the settings' input and writes everything to their output."""
    m = messages if messages is not None else tables.raw_export(spark, c.raw_export) if c.raw_export else tables.flat_json(spark, c.input)
    p = found or providers(spark, c)
    t = index.build(m, c, p)
    lists = index.insights(t)
    sinks.write_database(sinks.database(t), f"{c.db or c.output}/database")
    sinks.write_graph(t, f"{c.output}/graph")
    sinks.write_reports(t, lists, f"{c.output}/reports")
    sinks.write_transcripts(sinks.transcripts(t), c.output)
    if c.train_classifier:
        rows = index.examples(t)
        model, metrics = classifier.train(rows)
        classifier.save(spark, model, metrics, classifier.label_distribution(rows), c.train_classifier)
        if c.classifier_report:
            sinks.write_text(spark, json.dumps(metrics, indent=1), c.classifier_report)
    if c.compare_categories and "category_comparison" in t:
        agreed = C.comparison(t["category_comparison"].select("baseline", "model"))
        sinks.write_json(agreed.withColumn("agreement", X.percent(F.col("agreement_rate"))), f"{c.output}/comparison/categories")
        sinks.write_json(t["category_disagreements"], f"{c.output}/comparison/disagreements")
    titles = t["conversations"].select(F.col("conversation_id").alias("id"), "title")
    if p.tokenizers:
        at = c.threshold(p.description)
        for name, df in index.embedding_comparison(t["corpora"], titles, *p.tokenizers, at, at, c.max_similar_neighbors).items():
            sinks.write_json(df, f"{c.output}/comparison/tokenizers/{name}")
    if c.compare_embeddings and p.embedder:
        hashed = lambda corpora: index.hash_vectors(corpora, c.hash_embedding_dim)
        found = index.embedding_comparison(t["corpora"], titles, hashed, p.embedder, c.threshold("hash:"), c.threshold(p.description), c.max_similar_neighbors)
        for name, df in found.items():
            sinks.write_json(df, f"{c.output}/comparison/embeddings/{name}")
        if "category_comparison" in t:
            rows, counts = perspective(t, found["left"], found["right"])
            sinks.write_json(rows, f"{c.output}/comparison/perspective")
            sinks.write_text(spark, sinks.markdown("Perspectives", {"counts": counts, "strongest": rows.select("id", "title", "disagrees", "difference", "score", "strong")}), f"{c.output}/comparison/perspective_md")
    return t


def perspective(t: dict[str, DataFrame], left: DataFrame, right: DataFrame, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """The conversations on which providers differ most, by category and by neighbours, with titles and examples; and the counts over
    all. Ids come from all three sides."""
    wrong = t["category_comparison"].select(F.col("conversation_id").alias("id"), (F.col("model").isNotNull() & ~F.col("agrees")).alias("disagrees"))
    every = reports.perspective(wrong, left, right, 1 << 30)
    titles = t["conversations"].select(F.col("conversation_id").alias("id"), "title")
    best = every.join(titles, "id", "left").withColumn("title", F.coalesce("title", "id")).orderBy(F.col("score").desc(), F.upper("title"), "id").limit(top)
    return reports.perspective_lists(best, left, right).orderBy(F.col("score").desc(), F.upper("title"), "id"), reports.perspective_counts(every)


def compare_profiles(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The report tables of profiles whose outputs lie in ``root``/profile, written to ``root``/comparison as JSON, Markdown and CSV."""
    runs = tables.profile_run(spark, names[0], f"{root}/{names[0]}/reports")
    for n in names[1:]:
        runs = runs.unionByName(tables.profile_run(spark, n, f"{root}/{n}/reports"))
    out = profile_report(runs)
    for name in ("agreement", "summaries", "top_bridges"):
        sinks.write_json(out[name], f"{root}/comparison/{name}")
    for name in ("disagreements", "hot_paths"):
        sinks.write_csv(out[name], f"{root}/comparison/{name}")
    lists = {what: tables.profile_insights(spark, names, root, what) for what in ("categories", "bridges", "cross_category")}
    for what, df in lists.items():
        if df is not None:
            sinks.write_json(df, f"{root}/comparison/insights/{what}")
    sinks.write_text(spark, sinks.markdown("Profiles compared", out), f"{root}/comparison/report_md")
    return out


def profile_report(runs: DataFrame) -> dict[str, DataFrame]:
    """Of (profile, id, title, category, topic_label, cluster_label, bridge_score, perspective_score)."""
    matrix = reports.full_profile_matrix(runs)
    by_title = F.upper(F.coalesce("title", F.col("id").cast("string")))
    return {
        "summaries": reports.profile_summaries(runs),
        "agreement": reports.profile_agreement(runs),
        "top_bridges": reports.top_bridges(runs.where("bridge_score > 0")),
        "disagreements": matrix.where("categories > 1").orderBy(F.col("categories").desc(), F.col("max_bridge").desc(), by_title, "id"),
        "hot_paths": matrix.where("max_bridge > 0 or max_perspective > 0 or categories > 1").orderBy(F.col("max_bridge").desc(), F.col("max_perspective").desc(), by_title, "id").limit(75),
    }


def run_profiles(spark: SparkSession, c: Config, messages: DataFrame | None = None, names: tuple[str, ...] = ("heuristic", "mlnet", "hybrid", "onnx")) -> dict[str, DataFrame]:
    """Each profile after the other in one session, a failure ending the run, then their comparison."""
    explicit = {k: v for k, v in vars(c).items() if v != getattr(Config(), k) and k not in {"execution_profile", "output", *PROFILES["onnx"]}}
    for n in names:
        run(spark, profile(n, **(explicit | {"output": f"{c.output}/{n}"})), messages)
        store.release(spark)
    return compare_profiles(spark, c.output, names)


def main(args: list[str] | None = None) -> int:
    try:
        c = parse(sys.argv[1:] if args is None else args)
    except ValueError as e:
        print(e, USAGE, sep="\n", file=sys.stderr)
        return 2
    if c is None:
        print(USAGE)
        return 0
    spark = SparkSession.builder.appName("threadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if c.run_profiles:
        for name, df in run_profiles(spark, c).items():
            print(name, df.count())
        return 0
    p = providers(spark, c)
    for note in p.notes:
        print(note, file=sys.stderr)
    t = run(spark, c, found=p)
    t["summary"].show(truncate=False, vertical=True)
    for name, df in index.size_reports(t).items():
        print(name, df.first().asDict())
    store.release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
