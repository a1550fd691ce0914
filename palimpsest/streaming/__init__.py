"""palimpsest.streaming"""
