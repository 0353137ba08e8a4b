"""Training-data operators: language ID, deduplication, decontamination, search, scans, chat and mixing.

Every module holds one operator and the thin registered query ``opN_<name>`` that
applies it to a whole table.  Nothing outside this package imports it.
"""
