"""Abusive, hateful and sexual content, by nearest labelled examples."""
