"""Training-data operators; see :mod:`corvella.llm.queries` for the registered queries."""
