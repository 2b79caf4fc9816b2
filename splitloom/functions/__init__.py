"""Column expressions: id spellings, similarities, reductions."""
