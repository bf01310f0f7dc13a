"""Operators that prepare text corpora for language-model training.  Nothing else in speechstats imports this."""
