"""Transformers as stages of pyspark.ml: fitted in a Pipeline, saved and loaded with what they have learnt."""

from __future__ import annotations

import copy
from dataclasses import MISSING, fields

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, types as T

from .distributions import NotFittedError
from .sequences import DateSequence
from .transformers import CategoryBins, ContinuousBins, RareCategories, Reversible, Scheme

#: The transformers that a stage can hold, by name; register() adds others.
KINDS: dict[str, type[Reversible]] = {k.__name__: k for k in (CategoryBins, ContinuousBins, DateSequence, RareCategories, Scheme)}


def register(kind: type[Reversible]) -> type[Reversible]:
    """A decorator for a transformer of one's own: a dataclass of plain values whose learnt state ends in an underscore."""
    KINDS[kind.__name__] = kind
    return kind


def _settings(transformer: Reversible) -> dict:
    """What the transformer was made with; the seed of its noise stays out."""
    return {f.name: getattr(transformer, f.name) for f in fields(transformer) if not f.name.endswith("_") and f.name != "seed"}


def _learnt(transformer: Reversible) -> tuple[dict, dict[str, DataFrame]]:
    """The plain values and the tables (by attribute and column) of a fitted transformer's state."""
    plain, found = {}, {}
    for name, value in vars(transformer).items():
        if name.endswith("_") and name != "types_":
            if isinstance(value, dict) and any(isinstance(v, DataFrame) for v in value.values()):
                found |= {(name, column): table for column, table in value.items()}
            else:
                plain[name] = value
    return plain, found


def _made(settings: dict, name: str) -> Reversible:
    if name not in KINDS:
        raise ValueError(f"{name} is no known transformer")
    kind = KINDS[name]
    required = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING}
    if lacking := required - settings.keys():
        raise ValueError(f"the saved {name} lacks {sorted(lacking)}")
    return kind(**settings)


class _Stage(MLWritable, MLReadable):
    """What the estimator and the model share; the folder holds JSON and Parquet, and nothing in it is executed."""

    transformer: Reversible
    columns: list[str] | None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class TableTransform(Estimator, _Stage):
    """An Estimator that fits a copy of a transformer to columns of the table, to those the transformer names without any."""

    def __init__(self, transformer: Reversible, columns: list[str] | None = None) -> None:
        super().__init__()
        self.transformer, self.columns = transformer, columns

    def _fit(self, dataset: DataFrame) -> TableModel:
        own = copy.deepcopy(self.transformer)
        return TableModel(own.fit(dataset) if self.columns is None else own.fit(dataset, self.columns))


class TableModel(Model, _Stage):
    """The fitted form: transform() in pipelines, inverse_transform() on its own."""

    columns = None

    def __init__(self, transformer: Reversible) -> None:
        super().__init__()
        if not hasattr(transformer, "types_"):
            raise NotFittedError(f"{type(transformer).__name__} has not been fitted")
        self.transformer = transformer

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.transformer.transform(dataset)

    def inverse_transform(self, dataset: DataFrame, key: str | None = None, seed: str = "0") -> DataFrame:
        """Values back from codes, drawn by key and seed; a transformer that draws nothing needs no key."""
        return self.transformer.inverse_transform(dataset) if key is None else self.transformer.inverse_transform(dataset, key, seed)


class _Writer(MLWriter):
    def __init__(self, stage: TableTransform | TableModel) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802
        own = self.stage.transformer
        state = {"kind": type(own).__name__, "settings": _settings(own), "columns": self.stage.columns}
        if isinstance(self.stage, TableModel):
            plain, found = _learnt(own)
            state |= {"types": {c: t.json() for c, t in own.types_.items()}, "learnt": plain, "tables": [*map(list, found)]}
            for k, table in enumerate(found.values()):
                table.write.parquet(f"{path}/table-{k}")
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"state": state})


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableTransform | TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = metadata["state"]
        own = _made(state["settings"], state["kind"])
        if issubclass(self.cls, TableModel):
            own.types_ = {c: T._parse_datatype_json_string(t) for c, t in state["types"].items()}
            for name, value in state["learnt"].items():
                setattr(own, name, value)
            for k, (name, column) in enumerate(state["tables"]):
                own.__dict__.setdefault(name, {})[column] = self.sparkSession.read.parquet(f"{path}/table-{k}")
            stage = self.cls(own)
        else:
            stage = self.cls(own, state["columns"])
        stage._resetUid(metadata["uid"])
        return stage
