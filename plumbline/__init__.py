"""plumbline: depth-of-coverage analytics over intervals, written as Spark DataFrame plans."""

from plumbline.params import ClassifyParams, CoverageParams

__all__ = ["ClassifyParams", "CoverageParams"]
