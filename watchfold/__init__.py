"""Security-log analytics as Spark plans.

Packages: ``sources`` (readers and sinks), ``functions`` (Column -> Column),
``operators`` (DataFrame -> DataFrame), ``streaming`` (Structured Streaming
forms), ``plans`` (end-to-end pipelines, read API and the query catalogue).
"""
