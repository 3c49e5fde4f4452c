"""codeprep: Spark-native preparation of source-code corpora for training.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver.  Sub-packages:

* ``functions`` – column expressions (text normalisation, regexes, constants)
* ``sources``   – readers (JSON lines, source folders, tables, text files)
* ``sinks``     – writers (line files, parquet, vocabulary files, reject logs)
* ``operators`` – DataFrame operators (filters, dedup, tokens, vocabulary,
  encoding, tree distance, checks, numbering)
* ``plans``     – end-to-end stage compositions and the registered queries
* ``streaming`` – incremental ingestion with Structured Streaming
"""

__version__ = "0.1.0"
