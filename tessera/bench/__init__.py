"""Benchmark runner: single, throughput and trace mode, result checksums."""
