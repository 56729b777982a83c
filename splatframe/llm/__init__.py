"""Operations of a large-scale training-data pipeline, one module each.

Nothing else in the package imports this subpackage; :mod:`splatframe.llm.registry`
lists its queries and their SQL.
"""
