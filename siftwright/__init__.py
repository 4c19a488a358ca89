"""siftwright: build source-code corpora on Spark and flag what overlaps with other corpora."""
