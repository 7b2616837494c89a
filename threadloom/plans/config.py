"""Settings, execution profiles and the command line's flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """The resolved settings. Paths are Spark paths; empty means none."""

    input: str = ""
    output: str = "output"
    db: str = ""
    execution_profile: str = "custom"
    use_ollama: bool = False
    analysis_provider: str = "heuristic"
    cluster_labeler: str = "auto"
    ollama_url: str = "http://localhost:11434"
    ollama_model: str = ""
    models_dir: str = ""
    train_classifier: str = ""
    classifier_report: str = ""
    chunking_provider: str = "auto"
    chunk_chars: int = 1200
    chunk_max_tokens: int = 256
    chunk_overlap_tokens: int = 32
    onnx_tokenizer: str = "mltokenizer"
    onnx_execution_provider: str = "auto"
    cuda_device_id: int = 0
    directml_device_id: int = 0
    embedding_model: str = ""
    embedding_vocab: str = ""
    mlnet_model: str = ""
    category_provider: str = "hybrid"
    embedding_provider: str = "auto"
    embedding_max_tokens: int = 256
    hash_embedding_dim: int = 384
    similarity_threshold: float | None = None
    hash_similarity_threshold: float | None = None
    onnx_similarity_threshold: float | None = None
    max_similar_neighbors: int = 4
    cooccurrence_keywords: int = 6
    cooccurrence_min: int = 2
    compare_categories: bool = False
    compare_embeddings: bool = False
    compare_onnx_tokenizers: bool = False
    compare_models: bool = False
    #: Nested exports (a pattern of files) to read in place of ``input``'s flat messages.
    raw_export: str = ""
    #: All profiles one after the other, and their comparison.
    run_profiles: bool = False
    keywords: int = 18
    topics: int = 8

    def threshold(self, description: str) -> float:
        """The similarity threshold of a provider's description; a chain that names an ONNX model counts as one."""
        onnx = "onnx:" in description
        own = self.onnx_similarity_threshold if onnx else self.hash_similarity_threshold
        shared = own if own is not None else self.similarity_threshold
        return shared if shared is not None else 0.60 if onnx else 0.72

    def labels_clusters(self) -> bool:
        """Whether a language model names clusters: as told, and by default where one analyses."""
        return self.cluster_labeler == "ollama" or (self.cluster_labeler == "auto" and self.use_ollama)


CHOICES = {
    "execution_profile": ("custom", "heuristic", "mlnet", "hybrid", "onnx"),
    "analysis_provider": ("heuristic", "ollama"),
    "cluster_labeler": ("auto", "none", "ollama"),
    "chunking_provider": ("auto", "char", "mltokenizer"),
    "onnx_tokenizer": ("mltokenizer", "legacy"),
    "onnx_execution_provider": ("auto", "cpu", "cuda", "directml"),
    "category_provider": ("hybrid", "heuristic", "mlnet"),
    "embedding_provider": ("auto", "hash", "onnx"),
}
PROFILES = {
    "custom": {},
    "heuristic": {"category_provider": "heuristic", "embedding_provider": "hash", "chunking_provider": "char"},
    "mlnet": {"category_provider": "mlnet", "embedding_provider": "hash", "chunking_provider": "mltokenizer"},
    "hybrid": {"category_provider": "hybrid", "embedding_provider": "hash", "chunking_provider": "mltokenizer"},
    "onnx": {"category_provider": "hybrid", "embedding_provider": "onnx", "chunking_provider": "mltokenizer", "onnx_tokenizer": "legacy", "onnx_execution_provider": "auto"},
}
LEAST = {"chunk_max_tokens": 16, "embedding_max_tokens": 8, "hash_embedding_dim": 32, "max_similar_neighbors": 1, "cooccurrence_keywords": 2, "cooccurrence_min": 1, "chunk_overlap_tokens": 0}
SHORT = {"-i": "--input", "-o": "--output", "-h": "--help"}
USAGE = "usage: threadloom --input PATH [--output PATH] [--execution-profile NAME] [" + "] [".join(f"--{f.name.replace('_', '-')}" for f in fields(Config)[2:]) + "]"


def profile(name: str, **explicit) -> Config:
    """Explicit settings win over the profile's."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}")
    return validated(replace(Config(), **({"execution_profile": name} | PROFILES[name] | explicit)))


def validated(c: Config) -> Config:
    for name, allowed in CHOICES.items():
        if getattr(c, name) not in allowed:
            raise ValueError(f"--{name.replace('_', '-')} must be one of {', '.join(allowed)}")
    for name, least in LEAST.items():
        if getattr(c, name) < least:
            raise ValueError(f"--{name.replace('_', '-')} must be {least} or more")
    for name in ("similarity_threshold", "hash_similarity_threshold", "onnx_similarity_threshold"):
        value = getattr(c, name)
        if value is not None and not -1 <= value <= 1:
            raise ValueError(f"--{name.replace('_', '-')} must be between -1 and 1")
    return c


def parse(args: list[str]) -> Config | None:
    """The settings of command-line arguments; None if help is asked for. Unknown flags and missing values raise."""
    known, given, i = {f.name: f for f in fields(Config)}, {}, 0
    while i < len(args):
        flag = SHORT.get(args[i], args[i])
        if flag == "--help":
            return None
        name = flag[2:].replace("-", "_") if flag.startswith("--") else ""
        if name not in known:
            raise ValueError(f"unknown argument {args[i]}")
        kind = str(known[name].type)
        if kind == "bool":
            given[name], i = True, i + 1
            continue
        if i + 1 >= len(args) or re.match(r"--[a-z]", args[i + 1]):
            raise ValueError(f"{args[i]} needs a value")
        value = args[i + 1]
        try:
            given[name] = int(value) if kind == "int" else float(value) if kind.startswith("float") else value
        except ValueError:
            raise ValueError(f"{args[i]} needs a number, not {value}") from None
        i += 2
    if not given.get("input") and not given.get("raw_export"):
        raise ValueError("--input is required")
    if given.get("use_ollama") or given.get("analysis_provider") == "ollama":
        given |= {"use_ollama": True, "analysis_provider": "ollama"}
    if given.get("compare_models"):
        given |= {"compare_categories": True, "compare_embeddings": True, "compare_onnx_tokenizers": True}
    return profile(given.pop("execution_profile", "custom"), **given)
