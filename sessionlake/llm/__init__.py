"""Training-data operators: sharding, fingerprints, filters, tokenisation, de-duplication.

Each module holds one operator with a general interface; :mod:`.queries` registers
the thin ``opN_*`` queries that apply them to the whole driver tables.
"""
