"""scanloom.functions"""
