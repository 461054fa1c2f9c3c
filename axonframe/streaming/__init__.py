"""Stateful runs: networks tick by tick, replicates, streams."""
