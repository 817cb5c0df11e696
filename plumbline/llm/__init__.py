"""Training-data operators: one module for each, registered by :mod:`plumbline.llm.queries`."""
