"""Relational operators: classification checks, payload clean-up, consolidation, decisions, profiling, flattening."""
