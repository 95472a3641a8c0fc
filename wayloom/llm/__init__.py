"""Operators for preparing language-model training data, as Spark jobs.

Every operator takes and returns DataFrames and has its own general interface;
``queries`` holds the thin ``opN_*`` queries over the ``documents``, ``pages``
and ``conversations`` tables, and ``oracles`` their SQL where SQL can say it.
"""
