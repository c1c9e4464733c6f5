"""Cairn: DataFrame-to-DataFrame operators for memory graphs, event analytics and training-data curation on Spark."""
