"""Training-data operators: dedup, quality, decontamination, packing, binary output.

Nothing outside this package imports it.
"""
