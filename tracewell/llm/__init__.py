"""Operators of a training-data pipeline: deduplication, sharding, tokenisation, quality, archives and packing.

Result columns replace input columns of the same name; internal columns start with ``_t_``.
"""
