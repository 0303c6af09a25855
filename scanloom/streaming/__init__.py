"""scanloom.streaming"""
