"""palimpsest.sources"""
