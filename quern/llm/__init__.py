"""Training-data operators: cleaning, matching, modelling, packing and storing text corpora.

Nothing outside this subpackage imports it.
"""
