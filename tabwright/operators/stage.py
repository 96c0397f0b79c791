"""Base classes of the fitted stages: keyword parameters and saved state."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReader,
    MLWriter,
)


def param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc)


class Configured(Params):
    """Parameters from keywords; ``DEFAULTS`` names the optional ones."""

    DEFAULTS: dict = {}

    def __init__(self, **values):
        super().__init__()
        if self.DEFAULTS:
            self._setDefault(**self.DEFAULTS)
        if values:
            self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(name)


class StageTransformer(Configured, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    pass


class StageEstimator(Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    pass


class StageModel(Configured, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Small fitted state lives in the parameters themselves."""


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.save_state(path + "/state")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.load_state(self.sparkSession, path + "/state")
        return model


class TableModel(StageModel):
    """State that grows with the levels of the data: kept and saved as a table."""

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)
