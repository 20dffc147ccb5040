"""Training-data operators.

Nothing outside this subpackage imports it. Each operator is a plain function
over DataFrames; :mod:`tessera.llm.registry` binds them to the query names.
"""
