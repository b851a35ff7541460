"""annolens — literature annotations about genes, as Spark DataFrame jobs.

Layout:
  sources/    scans and sinks (annotation TSV, gene sets, gene lists,
              literature snapshots, stand-in views over the test tables)
  functions/  column expressions (text clean-up, prompts, tokens, XML)
  operators/  DataFrame -> DataFrame operators (resolve, lookup, chunk,
              model map, distill, embed)
  plans/      composite jobs and the query catalogue
"""

__version__ = "0.1.0"
