"""Training-data operators: filtering, deduplication, tokenising, packing and sharding.

Every module here stands on its own inputs and on general helpers of the
library; nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
