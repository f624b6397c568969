"""Operators for preparing training data: classify, de-duplicate, decontaminate, mix, tokenise, score."""
