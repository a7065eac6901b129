"""What is made once a worker by an adapter's factory: models and tokenizers that tasks share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle

#: What this worker has made, by what made it.
_MADE: dict[str, object] = {}


def once(factory: Callable[[], object]) -> Callable[[], object]:
    """A function for tasks that gives what ``factory`` makes, the same object to all tasks of a worker: factories are known by
    what is in them, as each task unpacks an object of its own."""
    name = hashlib.md5(cloudpickle.dumps(factory)).hexdigest()

    def made():
        if name not in _MADE:
            _MADE[name] = factory()
        return _MADE[name]

    return made
