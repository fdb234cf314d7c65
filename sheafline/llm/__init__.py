"""Operators for training-data pipelines.

Nothing outside this package imports it. ``queries.QUERIES`` and ``oracles.ORACLES`` hold the registered
queries; each operator module keeps its own general interface.
"""
