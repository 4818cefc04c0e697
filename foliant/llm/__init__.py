"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface; ``catalog``
binds them to the test tables as the ``opN_<name>`` queries.
"""
