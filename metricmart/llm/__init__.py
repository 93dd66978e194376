"""Operators for preparing training data: language mixture, near duplicates,
quality rules, substring and line dedup, archives, decontamination, tokens,
toxicity and language-model scores. Nothing else in the library imports this."""
