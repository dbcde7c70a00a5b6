"""Operators of a training-data pipeline (deduplication, packing, mixing, ...).

Nothing else in the library imports this subpackage; it may import the
library's general helpers. Each module is one operator; ``queries`` registers
one query per operator over the driver tables and ``oracles`` holds their SQL.
"""
