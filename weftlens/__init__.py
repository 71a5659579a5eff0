"""weftlens: a Spark-native engine for image-annotation datasets.

Projects, classes, files, splits, labels and contours are relational tables;
every operator is a function from DataFrames to DataFrames.
"""

__version__ = "0.1.0"
