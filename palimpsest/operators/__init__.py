"""palimpsest.operators"""
