"""Multi-track time-series work on Spark: catalogues, envelopes, mixes, levels, edit logs."""
