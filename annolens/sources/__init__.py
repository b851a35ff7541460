from . import annotations, genesets, sinks, standin  # noqa: F401
