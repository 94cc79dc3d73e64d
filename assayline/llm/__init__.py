"""Training-data operators: deduplication, filters, scoring, decontamination and packing.

Nothing else in the library imports this subpackage; `queries` lists its registered queries.
"""
