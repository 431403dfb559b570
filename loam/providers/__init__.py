"""Where vectors, scores and model answers come from: tables, deterministic columns, or services over HTTP."""
