"""Imports every module that registers queries."""

from textloom.plans import api, corpus, lexicons, patterns, punctuation, scalars, segments, sources, structure, training

MODULES = (api, corpus, lexicons, patterns, punctuation, scalars, segments, sources, structure, training)
