"""Registered queries (Spark) with their SQL oracles; importing fills the registry."""

from . import catalog, cleaning, features, forecasting, learned, presentation, selecting, streams  # noqa: F401
