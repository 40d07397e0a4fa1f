"""Training-data operators: near-duplicate join, line dedup, quality cascade, sketches,
HTML extraction, packing, chat formatting, language ID, BPE and token files.

Nothing else in the library imports this subpackage.
"""
