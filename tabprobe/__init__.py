"""tabprobe: evaluate feature-engineering methods on Spark tables of any size.

Pipeline: profile -> frozen hash-ordered train/test split -> train-only
encoders -> user feature method -> model panel -> one result row per
(dataset, method, model family) -> grouped/pivoted report tables.
Everything is DataFrame / SQL / Spark ML; fitted state lives in small
DataFrames or literals built from the training fold only.
"""

__version__ = "0.1.0"
