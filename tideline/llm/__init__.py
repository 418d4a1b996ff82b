"""Operators for preparing training text: extraction, fingerprints, deduplication, mixing, tokens.

Common to all: texts that are null count as empty unless the operator says otherwise, repeated
rows are rows of their own, an input column that bears the name of an output column is replaced,
and an empty table gives an empty result with the same columns.
"""
