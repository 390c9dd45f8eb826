"""Training-data operators: joins, mixing, token files, classifiers, extraction,
sharding, decontamination, chat formatting and quality rules.

Nothing else in the library imports this subpackage.
"""
