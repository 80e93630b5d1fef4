"""Settings of jobs: dataclasses with the shipped values, read from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Paths:
    raw_data_dir: str = "data/raw"
    metadata_csv: str = "data/raw/data_list.csv"
    processed_dir: str = "data/v2"
    index_dir: str = "data/index"
    evaluation_set: str = "data/v2/eval_questions.jsonl"
    evaluation_output: str = "outputs/eval_results.jsonl"


@dataclass
class Chunking:
    chunk_size: int = 1200
    chunk_overlap: int = 200
    min_chunk_chars: int = 80


@dataclass
class Hybrid:
    enabled: bool = True
    dense_top_k: int = 40
    bm25_top_k: int = 40
    rrf_k: int = 60


@dataclass
class Reranker:
    enabled: bool = True
    model: str = ""
    top_k: int = 10
    device: str = "auto"


@dataclass
class Retrieval:
    top_k: int = 10
    score_threshold: float = 0.0
    hybrid: Hybrid = field(default_factory=Hybrid)
    reranker: Reranker = field(default_factory=Reranker)


@dataclass
class Generation:
    max_context_chars: int = 12000
    temperature: float = 0.2


@dataclass
class Reading:
    """Settings of image readers."""

    engine: str = "vl"
    device: str = "gpu:0"
    threshold: float = 0.65
    least_confidence: float = 0.5


@dataclass
class Config:
    paths: Paths = field(default_factory=Paths)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    reading: Reading = field(default_factory=Reading)


def _filled(kind: type, values: dict, at: str) -> object:
    known = {f.name: f for f in fields(kind)}
    made = kind()
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {at}{name}")
        now = getattr(made, name)
        if is_dataclass(now):
            value = _filled(type(now), value or {}, f"{at}{name}.")
        elif isinstance(now, bool) != isinstance(value, bool) or not isinstance(value, (type(now), int) if isinstance(now, float) else type(now)):
            raise ValueError(f"{at}{name} must be {type(now).__name__}, not {value!r}")
        setattr(made, name, type(now)(value) if not is_dataclass(now) else value)
    return made


def load(path: str | Path | None = None) -> Config:
    """The settings of a file over the shipped ones; unknown names and values of another kind fail."""
    if path is None:
        return Config()
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return _filled(Config, json.loads(text) or {}, "")
    import yaml

    return _filled(Config, yaml.safe_load(text) or {}, "")
