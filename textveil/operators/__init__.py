"""DataFrame-level operators: detection, masking, recovery, entities, names, chunks, tokens, evaluation."""
