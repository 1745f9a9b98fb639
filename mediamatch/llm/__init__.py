"""Operators that prepare training corpora: search, secrets, licenses, duplicates, language, quality, scoring, packing."""
