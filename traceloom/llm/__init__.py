"""Training-data operators: token output, classifiers, fingerprints, dedup, decontamination, mixing.

Nothing else in the library imports this subpackage.
"""
