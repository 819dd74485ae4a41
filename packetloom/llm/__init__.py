"""Training-data operators: one module per operator, queries in :mod:`packetloom.llm.queries`."""
