"""Run configuration, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class RunConfig:
    """What a run reads, how its targets look, and how it is batched."""

    datasets: list[dict] = field(default_factory=list)
    val_datasets: list[str] = field(default_factory=list)
    eval_file: str = ""
    output_dir: str = ""
    max_samples: int = -1
    bpm_position: str = "last"
    asr_cot: bool = False
    shard_size: int = 50_000
    sample_rate: int = 16_000
    max_batch_tokens: int = 24_000
    max_batch_size: int = 64
    seed: int = 42

    @classmethod
    def of(cls, values: dict, **over) -> RunConfig:
        """From a mapping; keys it does not know are left out, given arguments that are not None win."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in {**values, **{k: v for k, v in over.items() if v is not None}}.items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str, **over) -> RunConfig:
        """From a YAML (if its library is there) or JSON file; ``output_dir`` is beside it unless it says otherwise."""
        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml

            values = yaml.safe_load(text) or {}
        except ImportError:
            import json

            values = json.loads(text)
        return cls.of({"output_dir": str(Path(path).resolve().parent / "preprocessed"), **values}, **over)
