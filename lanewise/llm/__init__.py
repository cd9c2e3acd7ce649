"""Operators for training-data pipelines.

Each operator is a module with a general function (``operator(df, ...)``) and
a thin query ``opN_<name>(spark, sf_dir)``; :mod:`lanewise.llm.registry` lists
the queries. Nothing outside this subpackage imports it.
"""
