"""Settings of the plans, as dataclasses that a command line can fill in."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, fields


# The names of the settings and what they are unless given.
@dataclass
class Prepare:
    src: str = "scraped_code"
    dst: str = "data"
    val_frac: float = 0.05
    seed: int = 0
    batch: int = 32
    max_file_bytes: int = 500 * 1024


@dataclass
class Sampling:
    block_size: int = 1024
    epoch_windows: int = 0
    max_steps: int = 20_000
    warmup_steps: int = 200
    lr: float = 3e-4
    min_lr: float = 3e-5
    eval_iters: int = 20
    log_interval: int = 10
    top_k: int = 40
    seed: int = 0
    verbose: bool = False


@dataclass
class Acquire:
    query: str = "language:Go license:mit"
    output_dir: str = "scraped_code"
    max_pages: int = 10
    max_file_bytes: int = 500 * 1024
    concurrency: int = 20


#: How a word is written that means truth.
TRUE = frozenset({"1", "true", "yes"})


class UsageError(SystemExit):
    """Arguments that can't be read; ends a command with code 2."""

    def __init__(self, message: str):
        print(message, file=sys.stderr)
        super().__init__(2)


def parsed(kind: type, args: Sequence[str] | None = None):
    """Settings of a kind from words ``--name value`` or ``--name=value``, where a name's ``_`` may be
    written ``-``; what isn't named keeps its default, and of a name given twice the last counts."""
    known, given = {f.name: type(f.default) for f in fields(kind)}, {}
    words = iter(sys.argv[1:] if args is None else args)
    for word in words:
        name, equals, value = word.removeprefix("--").partition("=")
        name = name.replace("-", "_")
        if not word.startswith("--") or name not in known:
            raise UsageError(f"unknown argument {word}; there are " + ", ".join(f"--{n.replace('_', '-')}" for n in known))
        value = value if equals else next(words, None)
        if value is None:
            raise UsageError(f"{word} needs a value")
        try:
            given[name] = value.lower() in TRUE if known[name] is bool else known[name](value)
        except ValueError:
            raise UsageError(f"{word} needs a value of type {known[name].__name__}, not {value}") from None
    return kind(**given)
