"""corpusmill: corpus preparation and language-model evaluation as Spark DataFrame jobs.

Subpackages: ``functions`` (column expressions), ``sources`` (scans and sinks), ``plans``
(ordering, chunking, size-checked joins, lineage cuts), ``operators`` (tokens, vocabulary,
stream, packing, metrics, n-gram models, generation, run queries, scoring, subwords) and
``streaming`` (incremental ingest). ``catalog`` registers one query per operator.
"""

__version__ = "0.1.0"
