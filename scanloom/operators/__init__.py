"""scanloom.operators"""
