"""Training-data operators: dedup, decontamination, language, URLs, packing, toxicity, scoring, personal data.

Each module holds one operator with a general interface; ``queries`` registers one query per operator.
Nothing else in the library imports this package.
"""
