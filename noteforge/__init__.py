"""noteforge: document classification as Spark jobs.

Raw notes, HTML or annotated XML become DataFrames, are de-identified,
tokenised, matched against concept dictionaries, vectorised, classified under
repeated stratified cross-validation, scored and saved.
"""

__version__ = "0.1.0"
