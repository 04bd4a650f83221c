"""Operators that prepare text, code and vectors for training. Optional: nothing else imports it."""
