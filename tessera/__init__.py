"""tessera: a PySpark-native engine for document knowledge, rule tables, retrieval and training-data preparation.

Layout
------
``functions``  Column-level building blocks (text normalisers, numbers, formula compiler).
``operators``  DataFrame -> DataFrame operators.
``sources``    readers and sinks.
``plans``      composed pipelines.
``streaming``  Structured Streaming forms.
``queries``    the catalog of runnable queries with their SQL twins.
``llm``        optional subpackage with the text-corpus operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
