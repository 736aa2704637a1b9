"""Tracked, reproducible analytics runs on Spark."""

from .names import Options, StoreError
from .refs import AsOf, Code, File, Hash, Label, Run, Sql, Variant
from .store import Store
from .sweeps import Batch, binds, envelopes, variants_of

__all__ = ["AsOf", "Batch", "Code", "File", "Hash", "Label", "Options", "Run", "Sql", "Store", "StoreError", "Variant", "binds", "envelopes", "variants_of"]
