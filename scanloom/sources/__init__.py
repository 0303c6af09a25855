"""scanloom.sources"""
