"""Longitudinal (entity x period) panel building on Spark DataFrames."""

from panel_engine.operators.impute import HierarchicalImputer, HierarchicalImputerModel

__all__ = ["HierarchicalImputer", "HierarchicalImputerModel"]
