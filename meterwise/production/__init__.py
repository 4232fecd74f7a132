"""A delivery day from end to end: inputs at the gate, models, learned mixes, quarters, archives and the daily run."""
