"""Parameters of the pipeline; each dataclass validates itself."""

from __future__ import annotations

from dataclasses import dataclass

PAD, NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2, 3
ITEM_PAD, ITEM_UNKNOWN, FIRST_ITEM = 0, 1, 2
TOKEN_PAD, TOKEN_BOS, TOKEN_OFFSET = 0, 1, 2
INVALID_STATE = -1


def _least(name: str, value: float | None, least: float) -> None:
    if value is not None and value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")


@dataclass(frozen=True)
class SplitConfig:
    min_interactions: int = 5
    max_history: int | None = 50
    positive: float = 4.0
    neutral: float = 3.0

    def __post_init__(self) -> None:
        _least("min_interactions", self.min_interactions, 3)
        _least("max_history", self.max_history, 1)
        if self.neutral > self.positive:
            raise ValueError("the neutral rating is above the positive one")


@dataclass(frozen=True)
class KnnConfig:
    candidates: int = 200
    history: int = 50

    def __post_init__(self) -> None:
        _least("candidates", self.candidates, 1)
        _least("history", self.history, 1)


@dataclass(frozen=True)
class EmbeddingConfig:
    components: int = 32
    history: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        _least("components", self.components, 1)
        _least("history", self.history, 1)


@dataclass(frozen=True)
class ClusterConfig:
    depth: int = 4
    branching: int = 16
    seed: int = 42
    restarts: int = 10
    iterations: int = 300

    def __post_init__(self) -> None:
        _least("depth", self.depth, 1)
        _least("branching", self.branching, 2)

    @property
    def capacity(self) -> int:
        return self.branching**self.depth
