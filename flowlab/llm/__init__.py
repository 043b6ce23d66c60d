"""Training-data operators: filters, classifiers, deduplication, mixing and search over document tables.

Nothing outside this subpackage imports it. Each module holds one operator
with a general interface and its thin ``opN_*`` query; ``registry`` lists the
queries and their SQL twins.
"""
