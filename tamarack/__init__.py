"""Entity analytics on Spark: declarations compiled to DataFrames, a write journal, replay, and corpus tools in ``llm``."""
