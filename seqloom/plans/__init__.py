from .registry import oracle, queries  # noqa: F401
