"""Transformers for pipelines of pyspark.ml over tiles."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from cellweave.operators.cells import explode_tiles, tile_columns


class TileExploder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """One row per cell, of all tile columns; other columns stay."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return explode_tiles(dataset, *tile_columns(dataset))


class NoDataFilter(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Without rows that lack data in any of the input columns that there are."""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=["tile"])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.na.drop(subset=[c for c in self.getInputCols() if c in dataset.columns])
