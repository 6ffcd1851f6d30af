"""cohortlab: curation and cohort analysis of tabular research data on Spark.

Sub-packages:
    sources    dataset registration, storage, export, fingerprints (S*)
    operators  profiling, cleansing, joins, features, selection,
               clustering and risk models (P*, C*, J*, F*, L*, K*, R*)
    functions  column-expression helpers shared by the operators
    plans      end-to-end flows and the catalogue of registered queries
    streaming  nothing: the reference has no stream (see its docstring)
"""

__version__ = "0.1.0"
