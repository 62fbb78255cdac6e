"""bastion — guarded retrieval analytics as Spark DataFrame operators.

Sub-packages:
  functions  Column -> Column builders (regex guards, routing, overlap metrics, vectors)
  operators  DataFrame -> DataFrame operators (access, retrieval, cache, monitoring, eval)
  sources    readers, driver-table mappings and sinks
  plans      composed batch pipelines (chat, ingest, evaluate)
  streaming  Structured Streaming pipelines (guard, monitor, cache replay)
"""

__version__ = "0.1.0"
