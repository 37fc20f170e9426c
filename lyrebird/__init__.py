"""Lyrebird: catalogue queries, entity resolution, signal checks and change ledgers on Spark."""

__version__ = "0.1.0"
