"""Operations for preparing training text on Spark.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
interface; ``queries.py`` registers them for the entry file.
"""
