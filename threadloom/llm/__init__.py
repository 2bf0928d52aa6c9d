"""Training-data operators: filters, classifiers, tokenisation, de-duplication, packing, search and media.

Nothing else in ``threadloom`` imports this subpackage; ``queries`` lists what ``__spark_entry__`` registers.
"""
