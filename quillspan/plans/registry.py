"""Stages that can be exchanged, by kind and name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from quillspan.operators import stages

KINDS: dict[str, type] = {"classifier": stages.Classifier, "extractor": stages.Extractor, "embedder": stages.Embedder, "retriever": stages.Retriever, "reranker": stages.Reranker, "gate": stages.Gate, "generator": stages.Generator}


class Registry:
    def __init__(self) -> None:
        self._made: dict[tuple[str, str], type] = {}

    @staticmethod
    def _kind(kind: str) -> type:
        if kind not in KINDS:
            raise KeyError(f"unknown kind {kind!r}; there are {', '.join(sorted(KINDS))}")
        return KINDS[kind]

    def register(self, kind: str, name: str) -> Callable[[type], type]:
        """A decorator. The class must be of its kind; a name is given once, except to the same class again."""
        base = self._kind(kind)

        def add(cls: type) -> type:
            if not (isinstance(cls, type) and issubclass(cls, base)):
                raise TypeError(f"{cls!r} is no {base.__name__}")
            if self._made.get((kind, name), cls) is not cls:
                raise ValueError(f"{kind} {name!r} is there already")
            self._made[kind, name] = cls
            return cls

        return add

    def unregister(self, kind: str, name: str) -> None:
        self._made.pop((kind, name), None)

    def find(self, kind: str, name: str) -> type:
        self._kind(kind)
        try:
            return self._made[kind, name]
        except KeyError:
            raise KeyError(f"no {kind} {name!r}; there are {', '.join(self.available(kind)) or 'none'}") from None

    def create(self, kind: str, name: str, **settings: Any) -> Any:
        return self.find(kind, name)(**settings)

    def available(self, kind: str) -> list[str]:
        self._kind(kind)
        return sorted(n for k, n in self._made if k == kind)


registry = Registry()
for _kind, _name, _cls in (("classifier", "keywords", stages.KeywordClassifier), ("extractor", "vocabulary", stages.VocabularyExtractor), ("embedder", "hashing", stages.HashingEmbedder), ("retriever", "bm25", stages.KeywordRetriever), ("retriever", "dense", stages.VectorRetriever), ("reranker", "coverage", stages.CoverageReranker), ("reranker", "classifier", stages.ClassifierReranker), ("gate", "thresholds", stages.ThresholdGate), ("generator", "extractive", stages.ExtractiveGenerator)):
    registry.register(_kind, _name)(_cls)
