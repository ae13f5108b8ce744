"""cartlens: customer-behaviour analytics as Spark DataFrame plans.

Sub-packages
------------
sources    reading customer tables, header/number cleaning, the ``shop`` view
functions  column expressions: spend features, maps, bins, crosses, flags
operators  aggregates and fitted transforms: rare labels, crosstabs,
           Cramer's V, splits, encodings, segmentation, evaluation
plans      end-to-end jobs: preparation, model comparison, scoring
streaming  the stateless scoring job over a streaming source
"""

__version__ = "0.1.0"
