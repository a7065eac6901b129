"""What a checkpoint folder tells without loading its model; driver-side, a few small files."""

from __future__ import annotations

import json
import re
import shutil
import struct
from collections.abc import Callable
from pathlib import Path

# The tensors whose rows are the vocabulary; the widest hidden layer of the smaller base model, and the names of both.
VOCABULARY_TENSORS = ("embed_tokens.weight", "lm_head.weight")
SMALL_HIDDEN = 1024
BASE_MODELS = ("Qwen/Qwen3-ASR-0.6B", "Qwen/Qwen3-ASR-1.7B")
# The files that make a checkpoint fit for inference.
NEEDED_FILES = (
    "config.json", "generation_config.json", "preprocessor_config.json", "processor_config.json", "tokenizer_config.json", "tokenizer.json",
    "special_tokens_map.json", "chat_template.json", "merges.txt", "vocab.json",
)


def latest(folder: str) -> str | None:
    """The sub-folder ``checkpoint-<number>`` of the greatest number."""
    found = [(int(m[1]), p) for p in (Path(folder).iterdir() if Path(folder).is_dir() else ()) if p.is_dir() and (m := re.fullmatch(r"checkpoint-(\d+)", p.name))]
    return str(max(found)[1]) if found else None


def tensor_shapes(path: Path) -> dict[str, list[int]]:
    """Shapes in the header of a safetensors file: eight bytes of length, then JSON."""
    with path.open("rb") as f:
        (size,) = struct.unpack("<Q", f.read(8))
        header = json.loads(f.read(size))
    return {k: v["shape"] for k, v in header.items() if isinstance(v, dict) and "shape" in v}


def vocabulary_size(folder: str) -> int | None:
    """Most rows of a vocabulary tensor in any of the folder's files."""
    rows = [shape[0] for p in sorted(Path(folder).glob("*.safetensors")) for name, shape in tensor_shapes(p).items() if name.endswith(VOCABULARY_TENSORS) and shape]
    return max(rows, default=None)


def hidden_size(config: dict) -> int:
    """The width of the text model: on the level of its own configuration, inside the speaking part's if there is one, else 0."""
    inner = config.get("thinker_config") or {}
    text = inner.get("text_config") or config.get("text_config") or {}
    return text.get("hidden_size", 0)


def base_model(folder: str, read_arguments: Callable[[str], object] | None = None) -> str:
    """The base model of a checkpoint: what its training arguments name (read by the adapter, which may fail), or by the
    width in its configuration, the larger one without."""
    arguments, config = Path(folder) / "training_args.bin", Path(folder) / "config.json"
    if read_arguments is not None and arguments.is_file():
        try:
            named = getattr(read_arguments(str(arguments)), "_name_or_path", None)
        except Exception:  # noqa: BLE001 - arguments that can't be read say nothing
            named = None
        if named is not None:
            return named
    if config.is_file():
        return BASE_MODELS[hidden_size(json.loads(config.read_text(encoding="utf-8"))) > SMALL_HIDDEN]
    return BASE_MODELS[1]


def copy_needed(source: str, target: str) -> list[str]:
    """Copies what inference needs beside the weights into a checkpoint, which is made if it is not there; names copied."""
    Path(target).mkdir(parents=True, exist_ok=True)
    there = [n for n in NEEDED_FILES if (Path(source) / n).is_file()]
    for n in there:
        shutil.copy2(Path(source) / n, Path(target) / n)
    return there
