"""Operators for training-data pipelines (sharding, deduplication, PII,
packing, decontamination, licences, toxicity, chat, near copies, quality).

Nothing else in the library imports this subpackage.
"""
