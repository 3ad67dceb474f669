"""cohortlens — cohort, history and risk analytics as PySpark DataFrame operators.

Layout:
  sources/    staging readers, exports, and the proxy views over the test tables
  functions/  column-expression builders (casts, dates, bands, recodes)
  operators/  DataFrame -> DataFrame operators (profiling, rates, history
              windows, ranking, lookups, evaluation, features, models)
  plans/      the analyses composed from operators, one module per study
  streaming/  (the studied analyses are batch only; see its docstring)
"""

__version__ = "0.1.0"
