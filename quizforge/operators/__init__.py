"""Operators on tables of question items, variants, images and model outputs."""
