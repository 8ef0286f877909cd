"""Column-level functions: catalogue, rules, spans, validators."""
