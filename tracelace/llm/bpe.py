"""Encoding many short strings with one tokenizer of the tokenizers library."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import Any

import numpy as np


def of_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in the life of a Python worker and used by all the tasks that it runs."""
    held = sys.__dict__.setdefault("_of_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]


def forget() -> None:
    """Drops what ``of_worker`` holds: a worker that turns to other functions needn't keep an encoder's words."""
    sys.__dict__.pop("_of_worker", None)


def load(path: str):
    """The tokenizer in a file, without truncation or padding; Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode_each(tokenizer, strings: list[bytes], special: str = "<|endoftext|>", at_once: int = 64) -> list[bytes]:
    """The ids of each string as little-endian unsigned 32-bit numbers, as if encoded alone.

    A special token always ends what stands before it, so strings are encoded many at a time with it between them;
    strings that hold "<|" themselves are encoded alone. Only calls to the library are saved.
    """
    out: list = [None] * len(strings)
    plain = [i for i, s in enumerate(strings) if b"<|" not in s]
    mark = tokenizer.token_to_id(special)
    groups = [plain[i : i + at_once] for i in range(0, len(plain), at_once)]
    joint = tokenizer.encode_batch_fast([special.join([strings[i].decode("utf-8", "replace") for i in g]) for g in groups], add_special_tokens=False)
    for g, e in zip(groups, joint, strict=True):
        ids = np.array(e.ids, "<u4")
        raw = ids.tobytes()
        ends = np.flatnonzero(ids == mark).tolist()
        for i, a, b in zip(g, [0, *[x + 1 for x in ends]], [*ends, len(ids)], strict=True):
            out[i] = raw[4 * a : 4 * b]
    for i, s in enumerate(strings):
        if out[i] is None:
            out[i] = np.array(tokenizer.encode(s.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    return out
