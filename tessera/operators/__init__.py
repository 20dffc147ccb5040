"""Relational operators over DataFrames."""

from .aggregates import Aggregate, aggregate
from .basic import constants, filter_rows, limit, project, sort, sort_key, top_n
from .joins import KINDS, cross, join, mark_join, single_join, theta_join
from .partition import gather, hash_split
from .transfer import BloomFilter, DynamicFilter, build, chain, filtered_join, runtime_bloom, transfer

__all__ = ["KINDS", "Aggregate", "BloomFilter", "DynamicFilter", "aggregate", "build", "chain", "constants", "cross", "filter_rows", "filtered_join", "gather", "hash_split", "join", "limit", "mark_join", "project", "runtime_bloom", "single_join", "sort", "sort_key", "theta_join", "top_n", "transfer"]
