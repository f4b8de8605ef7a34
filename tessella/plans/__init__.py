"""Registered queries of the note-corpus engine."""

from tessella.plans import events, neighbours, retrieval, rules, store

PLANS = (retrieval, rules, neighbours, events, store)
