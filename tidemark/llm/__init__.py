"""Operators of a training-data pipeline: scoring, counting, packing, duplicates, rules, secrets, personal data and chats."""
