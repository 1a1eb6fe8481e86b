"""Operators of a training-data pipeline: counting, packing, deduplication, filters.

Every operator takes DataFrames and the names of the columns it should read, keeps no state on
the driver that grows with the data, and can be lost and recomputed at any task. What has to be
cut from the lineage is written below the folder in ``spark.checkpoint.dir``.
"""
