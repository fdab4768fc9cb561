"""cairn: evidence and feedback analytics as Spark DataFrame jobs.

Sub-packages:
  sources/    readers for landed feeds, decks, ledgers and the driver tables
  functions/  column expressions (text cleaning, hashing, lexicon scoring)
  operators/  DataFrame -> DataFrame operators (gate, evidence, clustering, ...)
  plans/      fixture views over the driver tables and the registered queries
  streaming/  Structured Streaming forms of the stateful folds
"""

NOW = 1735689600  # fixed "now" (2025-01-01T00:00:00Z) used by every fixture query
