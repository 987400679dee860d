"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ("bpe", "packing", "sharding", "fingerprint", "toxicity", "language", "warc", "neardup", "topk", "htmltext", "linededup", "conversations", "whitening")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__name__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), "ORACLES", {})
    return out
