"""palimpsest.functions"""
